"""Header formats: a declarative line format becomes an anchored Java regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The public system-log data sets by name, with the file and the header format of each.
CATALOGUE: dict[str, tuple[str, str]] = {
    "HDFS": ("HDFS/HDFS_2k.log", r"<Date> <Time> <Pid> <Level> <Component>: <Content>"),
    "Hadoop": ("Hadoop/Hadoop_2k.log", r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>"),
    "Spark": ("Spark/Spark_2k.log", r"<Date> <Time> <Level> <Component>: <Content>"),
    "Zookeeper": ("Zookeeper/Zookeeper_2k.log", r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>"),
    "OpenStack": ("OpenStack/OpenStack_2k.log", r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>"),
    "BGL": ("BGL/BGL_2k.log", r"<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>"),
    "HPC": ("HPC/HPC_2k.log", r"<LogId> <Node> <Component> <State> <Time> <Flag> <Content>"),
    "Thunderbird": ("Thunderbird/Thunderbird_2k.log", r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>"),
    "Windows": ("Windows/Windows_2k.log", r"<Date> <Time>, <Level>                  <Component>    <Content>"),
    "Linux": ("Linux/Linux_2k.log", r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>"),
    "Mac": ("Mac/Mac_2k.log", r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>"),
    "Android": ("Android/Android_2k.log", r"<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>"),
    "HealthApp": ("HealthApp/HealthApp_2k.log", r"<Time>\|<Component>\|<Pid>\|<Content>"),
    "Apache": ("Apache/Apache_2k.log", r"\[<Time>\] \[<Level>\] <Content>"),
    "Proxifier": ("Proxifier/Proxifier_2k.log", r"\[<Time>\] <Program> - <Content>"),
    "OpenSSH": ("OpenSSH/OpenSSH_2k.log", r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>"),
}


@dataclass(frozen=True)
class LineFormat:
    headers: tuple[str, ...]
    pattern: str  # group k + 1 holds header k
    optional: frozenset[str] = frozenset()


def compile_format(fmt: str) -> LineFormat:
    """Fields in angle brackets are lazy groups, runs of spaces any white space; a group around
    an optional part is made non-capturing, so that group numbers are field numbers."""
    out, headers, at = [], [], 0
    for field in re.finditer(r"<([^<>]+)>", fmt):
        out += [fmt[at : field.start()], None]
        headers.append(field[1])
        at = field.end()
    out.append(fmt[at:])
    literal = lambda text: re.sub(r"(?<!\\)\((?!\?)", "(?:", re.sub(" +", r"\\s+", text))
    return LineFormat(tuple(headers), "^" + "".join("(.*?)" if x is None else literal(x) for x in out) + "$", frozenset(h for part in re.findall(r"\((.*?[^\\])\)\?", fmt) for h in re.findall(r"<([^<>]+)>", part)))


def for_dataset(name: str) -> LineFormat:
    return compile_format(CATALOGUE[name][1])
