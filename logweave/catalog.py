"""The query catalogue: name -> callable(spark, sf_dir), and the SQL that checks it.

There are no raw logs among the tables, so log lines are rendered from `events`, and
templates from the masked urls of `pages`. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import align, equivalence, text
from logweave.lineage import cut
from logweave.operators import adjudicate, clusters, matching, metrics, similarity
from logweave.plans import miner, sequential
from logweave.shipping import ship
from logweave.sources import formats, logs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EVENTS = formats.compile_format("<Date> <Time> <Level> <Component>: <Content>")


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(spark, sf_dir: str) -> DataFrame:
    """(LineId, value): events as log lines; every 97th has no header."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    content = F.concat(F.lit("user "), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" value="), cents, F.lit(" props="), F.coalesce("props", F.lit("")))
    level = F.when(F.col("event_type") == "error", "ERROR ").otherwise("INFO ")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit("web-"), F.col("user_id") % 7, F.lit(": "), content)
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("continued after "), "event_id")).otherwise(line)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("LineId"), line.alias("value"), "event_type", "user_id")


_RENDERED = r"""
r AS (SELECT event_id AS LineId, event_type, user_id,
  CASE WHEN event_id % 97 = 0 THEN 'continued after ' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR ' ELSE 'INFO ' END || 'web-' || (user_id % 7) || ': '
  || 'user ' || user_id || ' ' || event_type || ' value=' || CAST(round(value * 100) AS BIGINT) || ' props=' || coalesce(props, '') END AS value FROM events),
p AS (SELECT *, regexp_extract(value, '^(.*?)\s+(.*?)\s+(.*?)\s+(.*?):\s+(.*?)$', ['Date', 'Time', 'Level', 'Component', 'Content'], 's') AS h FROM r WHERE regexp_matches(value, '^.*?\s+.*?\s+.*?\s+.*?:\s+.*?$')),
l AS (SELECT LineId, event_type, user_id, h.Date AS Date, h.Time AS Time, h.Level AS Level, h.Component AS Component, h.Content AS Content FROM p)"""


def parsed(spark, sf_dir: str) -> DataFrame:
    return logs.parse_lines(rendered(spark, sf_dir), EVENTS, keep=("LineId", "event_type", "user_id"))


@query(f"WITH {_RENDERED} SELECT LineId, Date, Time, Level, Component, Content FROM l")
def header_extract(spark, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).drop("event_type", "user_id")


@query(f"WITH {_RENDERED} SELECT (SELECT count(*) FROM r) AS lines, (SELECT count(*) FROM r) - (SELECT count(*) FROM l) AS rejected")
def header_reject_count(spark, sf_dir: str) -> DataFrame:
    lines = rendered(spark, sf_dir)
    bad = ~logs.stripped("value").rlike(EVENTS.pattern)
    return lines.agg(F.count("*").alias("lines"), F.count_if(bad).alias("rejected"))


@query(f"WITH {_RENDERED} SELECT regexp_replace(Content, '[0-9]+', '<*>', 'g') AS template, count(*) AS occurrences FROM l GROUP BY 1")
def template_counts(spark, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).groupBy(text.digits_masked("Content").alias("template")).agg(F.count("*").alias("occurrences"))


@query(f"WITH {_RENDERED} SELECT row_number() OVER (ORDER BY LineId) AS line, LineId FROM l")
def dense_line_ids(spark, sf_dir: str) -> DataFrame:
    ordered = parsed(spark, sf_dir).select(F.col("LineId").alias("source")).repartitionByRange("source").sortWithinPartitions("source")
    return logs.with_line_ids(ordered).select(F.col("LineId").alias("line"), F.col("source").alias("LineId"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '  ', ' ', 'g')) AS squeezed FROM documents")
def normalize_space(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squeezed(text.stripped("text"))).alias("squeezed"))


_MASK = r"""regexp_replace(regexp_replace({c}, '/[a-zA-Z0-9\-._~:/?#@!$&''*+,;=]*', '<*>', 'g'), '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b', '<*>', 'g')"""


@query(f"SELECT page_id, {_MASK.format(c='url')} AS masked FROM pages")
def mask_paths_ips(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.masked("url").alias("masked"))


def url_shapes(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", text.digits_masked("url").alias("shape"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[0-9]+|[a-z]+', '<*>', 'g'), '<\*>(?:[^\p{L}\p{N} ]*<\*>)+', '<*>', 'g') AS merged FROM pages")
def merge_wilds(spark, sf_dir: str) -> DataFrame:
    loose = F.regexp_replace("url", "[0-9]+|[a-z]+", "<*>")
    return table(spark, sf_dir, "pages").select("page_id", text.merged_wildcards(loose).alias("merged"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[0-9]+', '<*>', 'g'), '[\p{L}\p{N}]*<\*>(?:[\p{L}\p{N}]|<\*>)*', '<*>', 'g') AS collapsed FROM pages")
def collapse_runs(spark, sf_dir: str) -> DataFrame:
    return url_shapes(spark, sf_dir).select("page_id", text.runs_collapsed(F.col("shape")).alias("collapsed"))


@query("SELECT page_id, unnest(range(len(s))) AS pos, unnest(s) AS symbol FROM (SELECT page_id, regexp_extract_all(regexp_replace(url, '[0-9]+', '<*>', 'g'), '<\\*>|.') AS s FROM pages)")
def symbol_split(spark, sf_dir: str) -> DataFrame:
    return url_shapes(spark, sf_dir).select("page_id", F.posexplode(text.symbols(F.col("shape"))).alias("pos", "symbol")).withColumn("pos", F.col("pos").cast("bigint"))


@query(r"SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s)<\*>|[\p{L}\p{N}]+|.')) AS token FROM conversations) GROUP BY ALL")
def tokens_alnum(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query(r"SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM conversations) WHERE regexp_matches(token, '\p{L}') GROUP BY ALL")
def tokens_letters(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.letter_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '[0-9]') THEN '0-9' ELSE '' END || CASE WHEN regexp_matches(url, '\p{L}') THEN 'a-zA-Z' ELSE '' END
  || array_to_string(list_sort(list_distinct(regexp_extract_all(url, '[^0-9\p{L}]'))), '') AS cls FROM pages""")
def char_class(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.char_class(F.col("url")).alias("cls"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '[\p{L}\p{N}]') AS has_alnum, regexp_matches(text, '\p{L}') AS has_letter, regexp_matches(text, '[a-zA-Z0-9]') AS has_ascii,
  contains(lower(text), 'yes') AS says_yes FROM conversations""")
def predicates(spark, sf_dir: str) -> DataFrame:
    c = F.col("text")
    flags = [text.has_alnum(c).alias("has_alnum"), text.has_letter(c).alias("has_letter"), text.has_ascii_alnum(c).alias("has_ascii"), text.says_yes(c).alias("says_yes")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *flags)


@query(r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 4 = 0 THEN 'ports a<*> end ' ELSE 'ports <*> end ' END WHEN 1 THEN 'ports a<*> b<*> a<*> end ' ELSE 'ports x x end ' END || page_id AS merged FROM pages""")
def repeat_collapse(spark, sf_dir: str) -> DataFrame:
    """Repeats of one token with a wildcard, once to four times; of two in turn; and of a word."""
    again = F.expr("repeat('a<*>  ', cast(page_id % 4 + 1 as int))")
    made = F.when(F.col("page_id") % 3 == 0, again).when(F.col("page_id") % 3 == 1, "a<*> b<*>\ta<*> ").otherwise("x x ")
    return table(spark, sf_dir, "pages").select("page_id", text.repeats_merged(F.concat(F.lit("ports "), made, F.lit("end "), "page_id")).alias("merged"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || ' done' WHEN 2 THEN 'first' END AS template FROM pages")
def answer_extract(spark, sf_dir: str) -> DataFrame:
    """Answers with two pairs of tags, with an end that is missing, with an empty last pair, and without tags."""
    kind, url = F.col("page_id") % 4, F.col("url")
    first = F.lit("Template: <START>first<END> then ")
    answer = F.when(kind == 0, F.concat(first, F.lit("<START> "), url, F.lit("\n<END> done"))).when(kind == 1, F.concat(F.lit("<START>"), url, F.lit(" done"))).when(kind == 2, F.concat(first, F.lit("<START><END>")))
    return table(spark, sf_dir, "pages").select("page_id", text.answer_text(answer.otherwise(url)).alias("template"))


_LETTERS = r"list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+'), lambda x: regexp_matches(x, '\p{{L}}'))"
_WORDS = r"list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{N}}\-_/.]+'), lambda x: regexp_matches(x, '^\p{{L}}+$'))"


@query(f"SELECT token, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest({_LETTERS.format(c='text')}) AS token FROM documents) GROUP BY 1")
def postings(spark, sf_dir: str) -> DataFrame:
    return similarity.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format(c='text')}) AS token FROM documents) GROUP BY ALL")
def term_freq(spark, sf_dir: str) -> DataFrame:
    return similarity.term_freq(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS qid, {_LETTERS.format(c='text')} AS t FROM conversations),
e AS (SELECT item_id AS cid, {_LETTERS.format(c='text')} AS t FROM benchmark),
h AS (SELECT qid, cid, count(*) AS hits FROM (SELECT qid, unnest(t) AS token FROM q) JOIN (SELECT DISTINCT cid, unnest(t) AS token FROM e) USING (token) GROUP BY ALL),
s AS (SELECT qid, cid, hits, coalesce(hits / nullif(len(q.t) + len(e.t) - hits, 0), 1.0) AS score FROM h JOIN q USING (qid) JOIN e USING (cid))
SELECT qid, cid, CAST(round(score * 1e9) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def knn_examples_topk(spark, sf_dir: str) -> DataFrame:
    """Every turn against every benchmark item: the top three are the feature."""
    q = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    found = similarity.nearest_examples(q, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cid"), "text"))
    return found.withColumn("score", F.round(F.col("score") * 1e9).cast("bigint"))


@query(f"""WITH u AS (SELECT regexp_replace(url, '[0-9]+', '<*>', 'g') AS t, min(page_id) AS id FROM pages GROUP BY 1),
w AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({_WORDS.format(c="regexp_replace(t, '[/.-]', ' ', 'g')")}) AS token FROM u) GROUP BY ALL),
n AS (SELECT id, sum(tf) AS n FROM w GROUP BY id),
o AS (SELECT a.id AS qid, b.id AS tid, sum(least(a.tf, b.tf)) AS overlap FROM w a JOIN w b ON a.token = b.token AND a.id <> b.id GROUP BY ALL),
s AS (SELECT qid, tid, overlap, overlap / (x.n + y.n) AS score FROM o JOIN n x ON x.id = qid JOIN n y ON y.id = tid)
SELECT qid, tid, CAST(overlap AS BIGINT) AS overlap FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) = 1""")
def template_similarity_top1(spark, sf_dir: str) -> DataFrame:
    """The distinct url templates of all pages, by the words between their delimiters, each against all others."""
    found = url_shapes(spark, sf_dir).groupBy("shape").agg(F.min("page_id").alias("id")).select("id", F.regexp_replace("shape", "[/.-]", " ").alias("text"))
    return similarity.similar_templates(found.withColumnRenamed("id", "qid"), found.withColumnRenamed("id", "tid")).select("qid", "tid", "overlap")


@query("""WITH c AS (SELECT min(page_id) AS cid, arg_min(url, page_id) AS y FROM pages GROUP BY split_part(url, '/', 3)),
d AS (SELECT page_id AS qid, cid, levenshtein(url, y) AS distance FROM pages, c)
SELECT qid, cid, CAST(distance AS INTEGER) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, cid) = 1""")
def levenshtein_nearest(spark, sf_dir: str) -> DataFrame:
    """Every url against the first of each host, a stated set as sampling compares with."""
    pages = table(spark, sf_dir, "pages")
    chosen = pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3))).agg(F.min("page_id").alias("cid"), F.min_by("url", "page_id").alias("text"))
    return similarity.nearest_by_distance(pages.select(F.col("page_id").alias("qid"), F.col("url").alias("text")), chosen.select("cid", "text"))


@query()
def diverse_sample(spark, sf_dir: str) -> DataFrame:
    """A sampling operator: 12 urls, far from each other."""
    found = similarity.diverse_sample(table(spark, sf_dir, "pages"), "url", 12)
    return spark.createDataFrame(list(enumerate(found)), "pos int, url string")


def truth_and_parse(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth: the event type. Parse: the same, but two types fused and one split by user."""
    lines = parsed(spark, sf_dir)
    split = F.when(F.col("event_type").isin("click", "view"), F.lit("click|view")).when(F.col("event_type") == "purchase", F.concat(F.lit("purchase-"), F.col("user_id") % 3)).otherwise(F.col("event_type"))
    masked = text.digits_masked("Content")
    truth = lines.select("LineId", F.col("event_type").alias("EventId"), F.regexp_replace(masked, r"\{.*\}", "<*>").alias("EventTemplate"))
    return truth, lines.select("LineId", split.alias("EventId"), F.regexp_replace(masked, r"\{.*\}", "{<*>}").alias("EventTemplate"))


_TRUTH = _RENDERED + r""",
g AS (SELECT LineId, event_type AS EventId, regexp_replace(regexp_replace(Content, '[0-9]+', '<*>', 'g'), '\{.*\}', '<*>', 'g') AS EventTemplate FROM l),
q AS (SELECT LineId, CASE WHEN event_type IN ('click', 'view') THEN 'click|view' WHEN event_type = 'purchase' THEN 'purchase-' || (user_id % 3) ELSE event_type END AS EventId,
  regexp_replace(regexp_replace(Content, '[0-9]+', '<*>', 'g'), '\{.*\}', '{<*>}', 'g') AS EventTemplate FROM l),
n AS (SELECT q.EventId AS p, g.EventId AS t, count(*) AS n FROM q JOIN g USING (LineId) GROUP BY ALL),
ok AS (SELECT p, t, n FROM n WHERE (SELECT count(*) FROM n m WHERE m.p = n.p) = 1 AND n = (SELECT sum(n) FROM n m WHERE m.t = n.t))"""


@query(f"WITH {_TRUTH} SELECT CAST(coalesce((SELECT sum(n) FROM ok), 0) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS lines, coalesce((SELECT sum(n) FROM ok), 0) / sum(n) AS ga FROM n")
def group_accuracy(spark, sf_dir: str) -> DataFrame:
    return metrics.group_accuracy(metrics.joined(*truth_and_parse(spark, sf_dir)))


@query(f"""WITH {_TRUTH}, c AS (SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM n) AS agreeing, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT sum(n) AS n FROM n GROUP BY p)) AS pairs_p,
  (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT sum(n) AS n FROM n GROUP BY t)) AS pairs_g)
SELECT agreeing, pairs_p, pairs_g, agreeing / pairs_p AS precision, agreeing / pairs_g AS recall, 2 * (agreeing / pairs_p) * (agreeing / pairs_g) / (agreeing / pairs_p + agreeing / pairs_g) AS f1 FROM c""")
def pair_f1(spark, sf_dir: str) -> DataFrame:
    return metrics.pair_f1(metrics.joined(*truth_and_parse(spark, sf_dir)))


_SCORES = _TRUTH + f""",
pt AS (SELECT EventId AS p, {equivalence.normalised_sql("arg_max(EventTemplate, LineId)")} AS x FROM q GROUP BY EventId),
gt AS (SELECT EventId AS t, {equivalence.normalised_sql("arg_max(EventTemplate, LineId)")} AS y FROM g GROUP BY EventId),
right_ AS (SELECT ok.* FROM ok JOIN pt USING (p) JOIN gt USING (t) WHERE x = y),
s AS (SELECT (SELECT coalesce(sum(n), 0) FROM ok) / (SELECT sum(n) FROM n) AS ga, (SELECT coalesce(sum(n), 0) FROM right_) / (SELECT sum(n) FROM n) AS pa,
  (SELECT count(*) FROM right_) / (SELECT count(DISTINCT EventId) FROM q) AS pta, (SELECT count(*) FROM right_) / (SELECT count(DISTINCT EventId) FROM g) AS rta)"""


@query(f"WITH {_SCORES} SELECT * FROM s")
def parse_accuracy(spark, sf_dir: str) -> DataFrame:
    return metrics.scores(*truth_and_parse(spark, sf_dir))


@query(f"WITH {_TRUTH} SELECT EventId AS event, arg_max(EventTemplate, LineId) AS template FROM q GROUP BY EventId")
def last_template(spark, sf_dir: str) -> DataFrame:
    return metrics.last_template(truth_and_parse(spark, sf_dir)[1])


@query(f"WITH {_SCORES} SELECT m AS metric, v AS events FROM s UNPIVOT (v FOR m IN (ga, pa, pta, rta))")
def score_transpose(spark, sf_dir: str) -> DataFrame:
    return metrics.transposed(metrics.scores(*truth_and_parse(spark, sf_dir)).withColumn("dataset", F.lit("events")), ["events"])


_VARIANTS = r"""CASE page_id % 8 WHEN 0 THEN 'blk_<*> ' WHEN 1 THEN '"<*>": ' WHEN 2 THEN '<*>:<*>/' WHEN 3 THEN 'took <*> ms, ' WHEN 4 THEN '((<*>)) ' WHEN 5 THEN '0x<*> <*>MB ' WHEN 6 THEN '<*> bytes <*> ' ELSE 'core.<*>.0 #' END"""


@query(f"SELECT page_id, {equivalence.normalised_sql('t')} AS normalised FROM (SELECT page_id, {_VARIANTS} || regexp_replace(url, '[0-9]+', '<*>', 'g') AS t FROM pages)")
def normalize_equivalence(spark, sf_dir: str) -> DataFrame:
    return url_shapes(spark, sf_dir).select("page_id", equivalence.normalised(F.concat(F.expr(_VARIANTS), F.col("shape"))).alias("normalised"))


@query(f"""WITH {_RENDERED} SELECT LineId, CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 10 = 3 THEN event_type || ' of ' || user_id ELSE event_type END AS template FROM l""")
def template_match(spark, sf_dir: str) -> DataFrame:
    """Every line against a template for each event type but errors, and one for each type and some users, whose constants go before wildcards."""
    lines = parsed(spark, sf_dir).where("user_id is not null").withColumn("who", F.col("user_id").cast("string"))
    types = lines.where("event_type <> 'error'").select("event_type", F.lit("<*>").alias("who")).union(lines.where("event_type <> 'error' and user_id % 10 = 3").select("event_type", "who")).distinct()

    @F.pandas_udf("string")
    def compiled(t):
        return t.map(lambda x: matching.pattern(x, ["0-9"] * (x.count("<*>") - 1) + ["".join(map(chr, range(32, 127))) + "0-9a-zA-Z"]))

    ship(spark)
    shape = F.concat(F.lit("user "), "who", F.lit(" "), "event_type", F.lit(" value=<*> props=<*>"))
    name = F.when(F.col("who") == "<*>", F.col("event_type")).otherwise(F.concat("event_type", F.lit(" of "), "who"))
    templates = cut(types.select(F.xxhash64("event_type", "who").alias("cid"), name.alias("name"), shape.alias("template")).withColumn("pattern", compiled("template")))
    found = matching.matched(lines.select("LineId", F.col("Content").alias("content")), templates)
    return found.join(templates.select("cid", "name"), "cid", "left").select("LineId", F.col("name").alias("template"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true WHEN page_id % 3 = 1 THEN false ELSE false END AS same FROM pages""")
def answers_lookup_symmetric(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a"), "page_id").alias("one"), F.concat(F.lit("b"), "page_id").alias("two"))
    straight = pages.where("page_id % 3 = 1").select(F.col("one").alias("key1"), F.col("two").alias("key2"), F.lit("No.").alias("answer"))
    back = pages.where("page_id % 3 < 2").select(F.col("two").alias("key1"), F.col("one").alias("key2"), F.lit("Yes.").alias("answer"))
    found = adjudicate.same_answers(pages.select("one", "two"), straight.unionByName(back))
    return pages.join(found, ["one", "two"]).select("page_id", "same")


@query("""SELECT source, CASE WHEN row_number() OVER (ORDER BY md5(source), source) <= (count(*) OVER () + 1) // 2 THEN 'A' ELSE 'B' END AS grp FROM (SELECT DISTINCT source FROM documents)""")
def group_split(spark, sf_dir: str) -> DataFrame:
    """Data sets, here the sources, in two halves by a seeded order: as many rows as there are sources."""
    names = table(spark, sf_dir, "documents").select("source").distinct()
    at = F.row_number().over(Window.orderBy(F.md5(F.col("source").cast("binary")), "source"))
    return names.select("source", F.when(at <= F.floor((F.count("*").over(Window.partitionBy()) + 1) / 2), "A").otherwise("B").alias("grp"))


@query("""WITH s AS (SELECT source, CASE WHEN row_number() OVER (ORDER BY md5(source), source) <= (count(*) OVER () + 1) // 2 THEN 'A' ELSE 'B' END AS grp FROM (SELECT DISTINCT source FROM documents)),
c AS (SELECT source, grp, count(*) AS n FROM documents JOIN s USING (source) GROUP BY ALL)
SELECT a.source, CAST(sum(b.n) FILTER (b.source <> a.source) AS BIGINT) AS leave_one_out, CAST(sum(b.n) FILTER (b.grp <> a.grp) AS BIGINT) AS other_group FROM c a, c b GROUP BY a.source""")
def leave_one_out_pool(spark, sf_dir: str) -> DataFrame:
    """Rows in the example pool of each source: all others, or those of the other group."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).join(group_split(spark, sf_dir), "source")
    total, groups = sizes.agg(F.sum("n").alias("total")), sizes.groupBy("grp").agg(F.sum("n").alias("in_group"))
    out = sizes.join(groups, "grp").join(F.broadcast(total))
    return out.select("source", (F.col("total") - F.col("n")).alias("leave_one_out"), (F.col("total") - F.col("in_group")).alias("other_group"))


@query(f"""WITH {_RENDERED}, m AS (SELECT LineId, Content, event_type, regexp_replace(Content, '[0-9]+', '<*>', 'g') AS key FROM l),
a AS (SELECT key, arg_max(Content, LineId) AS template FROM m WHERE event_type <> 'view' GROUP BY key)
SELECT LineId, template FROM m LEFT JOIN a USING (key)""")
def content_lookup_last(spark, sf_dir: str) -> DataFrame:
    """Each line's template by its content, from the lines of all types but one; of several the last wins, and a content without any has none."""
    lines = parsed(spark, sf_dir).select("LineId", "event_type", text.digits_masked("Content").alias("content"), F.col("Content").alias("template"))
    known = lines.where("event_type <> 'view'").select(F.col("LineId").alias("at"), "content", "template")
    return similarity.looked_up(lines.select("LineId", "content"), known).select("LineId", "template")


@query()
def subsume_components(spark, sf_dir: str) -> DataFrame:
    """Url templates at two levels of detail, consolidated by coverage."""
    fine = url_shapes(spark, sf_dir).select(F.explode(F.array("shape", F.regexp_replace("shape", r"//[^/]+/", "//<*>/"))).alias("template")).distinct()
    return clusters.consolidated(fine.select(F.xxhash64("template").alias("tid"), "template"))


@query()
def align_ground(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = parsed(spark, sf_dir).select(F.col("Content").alias("log")).distinct()
    found = rows.withColumn("g", align.grounded(text.digits_masked("log"), "log"))
    return found.select("log", "g.template", F.array_join("g.contents", "|").alias("contents"))


@query()
def candidate_units(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = parsed(spark, sf_dir).select(F.col("Content").alias("log")).distinct()
    units = rows.select("log", F.posexplode(align.candidate_units(F.regexp_replace("log", r"value=[0-9]+", "value=<*>"), "log")).alias("pos", "u"))
    return units.select("log", "pos", "u.text", "u.content")


@query(f"""WITH {_RENDERED} SELECT LineId, CAST(1 + CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS INTEGER) AS units FROM l""")
def candidate_counts(spark, sf_dir: str) -> DataFrame:
    """How many units of a line are to be judged: a number left as a constant, an address of clicks, an address and a path of views."""
    ship(spark)
    more = F.when(F.col("event_type") == "click", " from 10.0.0.7").when(F.col("event_type") == "view", " from 10.0.0.7 of /a/b").otherwise("")
    lines = parsed(spark, sf_dir).select("LineId", F.concat(F.lit("user "), "user_id", F.lit(" "), "event_type", more).alias("log"))
    return lines.select("LineId", F.size(F.filter(align.candidate_units("log", "log"), lambda u: u["content"] != "")).alias("units"))


@query(r"""WITH s AS (SELECT page_id, url, regexp_replace(url, '[0-9]+', '<*>', 'g') AS shape, regexp_replace(regexp_replace(url, '[0-9]+', '<*>', 'g'), '://[^/]+/', '://x.y.org/') AS other FROM pages)
SELECT page_id, true AS own, split_part(shape, '/', 3) = 'x.y.org' AS other FROM s""")
def template_cover(spark, sf_dir: str) -> DataFrame:
    """Each url's shape against the url, which it covers, and against the shape of the same path at another host, which it doesn't."""
    ship(spark)
    rows = url_shapes(spark, sf_dir).withColumn("moved", F.regexp_replace("shape", "://[^/]+/", "://x.y.org/"))
    pairs = rows.select("shape", F.explode(F.array(F.col("url"), F.col("moved"))).alias("two")).distinct()
    found = cut(pairs.select("shape", "two", align.covered("shape", "two")["covers"].alias("covers")))
    own = rows.join(found, (rows["shape"] == found["shape"]) & (rows["url"] == found["two"])).select("page_id", F.col("covers").alias("own"))
    other = rows.join(found, (rows["shape"] == found["shape"]) & (rows["moved"] == found["two"])).select("page_id", F.col("covers").alias("other"))
    return own.join(other, "page_id")


@query()
def mine_events(spark, sf_dir: str) -> DataFrame:
    """The whole log of events, mined."""
    return miner.mine(parsed(spark, sf_dir).select("LineId", "Content"))[1]


@query()
def mine_in_order(spark, sf_dir: str) -> DataFrame:
    """The order-sensitive fold; one data set for each hundred users."""
    lines = parsed(spark, sf_dir).select(F.floor(F.col("user_id") / 100).cast("bigint").alias("dataset"), "LineId", F.col("Content").alias("content"))
    return sequential.mine_in_order(lines)
