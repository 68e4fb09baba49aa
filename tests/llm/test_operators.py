"""Each operator against a brute-force version, on texts with nulls, empties, ties and repeats, and clashing columns."""

import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.llm import chat, images, minhash, packing, pieces, quality, sharding, suffix_tree, toxicity, vectors

TEXTS = [
    "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark wood today",
    "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark wood now",
    "THE QUICK brown fox jumps over the lazy dog and runs far away from the big bad wolf in the dark wood today",
    "", None, "   \n\t", "one two", "one two", "one  two three", "a b c d e f g", "café été 漢字 \U0001f600 naïve", "x " * 3000, "y" * 9000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "n", 1) for k, t in enumerate(TEXTS)] + [(None, "one two", "n", 1), (3, "", "n", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ref string, bucket int").withColumn("class", F.lit("clash"))


def word_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_minhash(spark, docs):
    got = minhash.near_duplicates(docs, width=4).collect()
    assert len(got) == docs.count()
    sets = [word_set(t, 4) for t in TEXTS]
    near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and 100 * len(a & b) >= 80 * len(a | b)}
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (1, 6, False)
        else:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["component_id"] == min([j for i, j in near if i == r["doc_id"]], default=r["doc_id"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    signer, rng = minhash.Signer(200, 1), np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    one, two = np.unique(base[:300]), np.unique(base[60:360])
    same = (signer.signature(one) == signer.signature(two)).mean()
    assert abs(same - 240 / 360) < 0.12
    few = np.unique(base[:3])
    assert len(np.unique(signer.signature(few))) == 3


def test_sharding(spark, docs):
    got = sharding.shard(docs, shards=4).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == docs.count() and counts.max() - counts.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    null = got[got["size"] == 16]
    assert set(null.text_crc32) == {0}
    assert sharding.shard(docs.limit(0)).count() == 0


def test_overflow_fills_every_shard():
    placed = sharding.overflow([7, 0, 5], [0, 2, 1], [0, 1, 2], [4, 4, 4])
    total = Counter()
    for parts in placed:
        for k, n in parts:
            total[k] += n
    assert total == {0: 4, 1: 4, 2: 4} and placed[0][0] == (0, 4)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, packing.default_tokenizer(), capacity=64).toPandas()
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in TEXTS]
    for r in got[got.doc_id.notna()].itertuples():
        want = ids[int(r.doc_id)]
        assert list(r.ids) == want[r.start : r.start + r.length] and r.doc_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert got.length.sum() == sum(map(len, ids)) + len(ids[7]) + 1
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        n = x.length.sum()
        assert n == 64 or n & (n - 1) == 0
        assert list(x.offset) == [0, *np.cumsum(x.length)[:-1]]
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_level_minimises_squares():
    rng, packer = np.random.default_rng(1), packing.Packer(16, lambda w: None)
    for _ in range(200):
        size = int(rng.integers(1, 16))
        cost = {}
        for h in range(16 - size + 1):
            if h and not packer.count[h]:
                continue
            c = packer.count.copy()
            c[h] -= bool(h)
            c[h + size] += h + size < 16
            cost[h] = int((c**2).sum())
        assert cost[packer.level_for(size)] == min(cost.values())
        packer.add(None, np.zeros(size, np.uint32))


def test_sentencepiece(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = pieces.encode(docs, pieces.default_model()).where("doc_id is not null").collect()
    assert all(r["ids"] == sp.encode(TEXTS[r["doc_id"]] or "") for r in got)
    back = pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model()).where("doc_id is not null").collect()
    assert all(r["text"] == (TEXTS[r["doc_id"]] or "") for r in back)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    v = pieces.Vocabulary([(p, float(-rng.random())) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "aab", "cab"]], None, 0, "unigram")
    words = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 9)))) for _ in range(200)})

    def best(word):
        if not word:
            return 0.0
        return max(v.scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in v.scores)

    for word, parts in zip(words, v.segment(words), strict=True):
        assert "".join(parts) == word and abs(sum(v.scores[p] for p in parts) - best(word)) < 1e-9


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"k1","name":"add","arguments":{"b":2,"a":1}},{"id":"k2","name":"add","arguments":"{\\"a\\":\\"x\\",\\"z\\":1}"}]}'),
        (1, 2, "tool", '{"tool_call_id":"k2","content":"3"}'), (2, 0, "tool", '{"tool_call_id":"late","content":"r"}'), (2, 5, "assistant", '{"tool_calls":[{"id":"late","name":"other","arguments":{}}]}'),
        (3, 0, "user", None), (None, 0, "user", "{broken"), (4, 0, "tool", '{"tool_call_id":"none","content":""}'), (4, 0, "tool", '{"tool_call_id":"none","content":""}'),
    ]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("kind", F.lit("clash"))
    got = {(r["conv_id"], r["turn"], r["seq"]): r for r in chat.chat_format(messages, {"add": {"a": ("integer", True), "b": ("integer", True)}}).collect()}
    assert got[1, 1, 0]["json"] == '{"arguments":{"a":1,"b":2},"id":"k1","name":"add"}' and got[1, 1, 0]["problems"] == [] and not got[1, 1, 0]["linked"]
    assert got[1, 1, 1]["problems"] == ["missing:b", "type:a", "unknown:z"] and got[1, 1, 1]["linked"]
    assert got[2, 0, 0]["place"] == 5 and got[2, 0, 0]["step"] == 2 and got[2, 5, 0]["problems"] == ["unknown tool"]
    assert got[3, 0, 0]["json"] == '{"content":"","role":"user"}' and got[None, 0, 0]["kind"] == "message"
    assert got[4, 0, 0]["problems"] == ["unknown call"]
    assert chat.chat_format(messages.limit(0), {}).count() == 0


def test_chat_keeps_content_beside_calls(spark):
    rows = [
        (1, 0, "assistant", '\n\t{"content":"look","tool_calls":[{"id":"k","name":"f","arguments":{}}]}'), (1, 1, "tool", '\r\n{"tool_call_id":"k","content":"3"}'),
        (2, 0, "assistant", '{"content":"","tool_calls":[{"id":"k","name":"f","arguments":{}}]}'), (2, 1, "assistant", '{"content":null,"tool_calls":[{"id":"m","name":"f","arguments":{}}]}'),
    ]
    found = chat.chat_format(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), {"f": {}}).collect()
    got = {(r["conv_id"], r["turn"], r["step"]): r for r in found}
    assert len(found) == len(got) and set(got) == {(1, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 1)}
    assert got[1, 0, 0]["json"] == '{"content":"look","role":"assistant"}' and got[1, 0, 0]["kind"] == "message"
    assert got[1, 0, 1]["linked"] and got[1, 1, 2]["linked"] and got[1, 1, 2]["name"] == "f"


def test_suffix_tree(spark, docs):
    got = suffix_tree.score(docs).where("doc_id is not null").collect()
    assert len(got) == docs.count() - 1
    words = {k: [*(t or "").encode().lower().split(), b""] for k, t in enumerate(TEXTS)}
    rows = [*words.items(), (None, words[6]), (3, [b""])]
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    c = Counter(w for k, ws in rows if not held(k) for w in ws)
    total, kinds = sum(c.values()), len(c)
    for r in got:
        ws = words[r["doc_id"]]
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(c[w] > 0 for w in ws) and r["train_tokens"] == total
        assert abs(r["base_score"] - sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in ws)) < 1e-6
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_spelling_is_a_distribution():
    rows = pd.DataFrame({"context": [0, 0, 0], "suffix": [0, 0, 0], "next": [97, 98, suffix_tree.SYMBOLS - 1], "c": [5, 3, 2]})
    level = suffix_tree._level(rows, None)
    seen = level.p.sum()
    assert abs(seen + level.weight[0] * (suffix_tree.SYMBOLS - 3) / suffix_tree.SYMBOLS - 1) < 1e-12


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    x = np.vstack([base, base[:20] + rng.normal(size=(20, 8)) * 0.1, base[:5] * 3, base[:5]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [1.0] + [None] * 7), (503, [float("nan")] * 8), (504, [1.0, 2.0]), (505, [])]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), size=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    for k in range(len(x)):
        assert got[k]["n_links"] == near[k].sum() - 1
    for k in range(500, 506):
        assert got[k]["n_links"] == 0 and got[k]["component_id"] == k
    for k in range(len(x)):
        reach = {k}
        while (more := {int(j) for i in reach for j in np.flatnonzero(near[i])}) - reach:
            reach |= more
        assert got[k]["component_id"] == min(reach)


def test_images():
    rng = np.random.default_rng(5)
    blend = np.maximum(1 - np.abs(np.linspace(0, 7, 64)[:, None] - np.arange(8)), 0)
    draw = lambda: np.rint(blend @ rng.integers(30, 220, (8, 8)) @ blend.T).astype(np.uint8)
    a, b = draw(), draw()
    crop, edit = np.ascontiguousarray(a[6:60, 4:62]), (a * 0.8 + 20).astype(np.uint8)
    fa, fb, fc, fe, ft = (images.features(x[None])[0] for x in (a, b, crop, edit, np.ascontiguousarray(np.rot90(a))))
    assert images.agreement(fa, fb) < 8
    assert min(images.agreement(fa, x) for x in (fc, fe, ft)) >= 8


def test_image_copies(spark):
    rng = np.random.default_rng(6)
    blend = np.maximum(1 - np.abs(np.linspace(0, 7, 64)[:, None] - np.arange(8)), 0)
    pics = [np.rint(blend @ rng.integers(30, 220, (8, 8)) @ blend.T).astype(np.uint8) for _ in range(6)]
    crop = np.ascontiguousarray(pics[0][6:60, 4:62])
    rows = [(k, 64, 64, p.tobytes()) for k, p in enumerate(pics)] + [(10, 54, 58, crop.tobytes()), (11, 64, 64, pics[1].tobytes()), (12, 64, 64, None), (13, 3, 3, b"xx")]
    got = {r["id"]: r["copy_id"] for r in images.near_images(spark.createDataFrame(rows, "id bigint, height int, width int, pixels binary")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 0, 11: 1, 12: 12, 13: 13}


def labelled(spark, n=600):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(vocabulary, 60))
        bad, toxic = k % 5 == 0, k % 4 == 1
        if toxic:
            for at in rng.integers(0, 60, 5):
                words[at] = "zznasty"
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        labels.append((k, 0 if bad else 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    docs, labels = labelled(spark)
    got = module.classify(docs, labels).toPandas()
    truth = labels.toPandas().set_index("doc_id")[label]
    held = got[got.held_out & got.doc_id.isin(truth.index)]
    assert len(got) == docs.count() and len(held) > 50 and got.score.between(0, 1).all()
    assert (held.predicted.to_numpy() == truth.loc[held.doc_id].to_numpy()).mean() > 0.95
    none = module.classify(docs.limit(5), labels.limit(0)).toPandas()
    assert set(none.score) == {0.5}


def test_segments_are_the_maximal_ones():
    s = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(0, 1), (2, 3), (4, 11)]


def test_minhash_in_crowds(spark):
    """Crowds that share passages without being links, against all pairs; every turn's rules are used."""
    rng = np.random.default_rng(12)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    base = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(150):
        words = list(base[k % 3])
        for at in rng.integers(0, 60, rng.integers(0, 5)):
            words[at] = word()
        texts.append(words[: rng.integers(40, 61)] if k % 4 == 0 else words)
    texts += [base[0] + [word() for _ in range(k)] for k in range(0, 30, 2)] + [base[0] + base[1], base[0] + base[1] + [word()]]
    texts = [" ".join(x) for x in texts]
    sets = [word_set(t, 4) for t in texts]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, a in enumerate(sets):
            for j in range(i):
                if low[i] != low[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for few in (128, 4):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows, width=4, few=few).collect()}
        assert [got[k] for k in range(len(texts))] == low


def test_minhash_ends_large_crowds_in_few_turns(spark, monkeypatch):
    """Near copies of one text, some just beyond a link with it, and of a much longer text that holds it: all pairs' result, without a turn for each hub."""
    rng = np.random.default_rng(31)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    base, texts = [word() for _ in range(100)], []
    for k in range(240):
        words = list(base)
        for _ in range(rng.integers(1, 8)):
            at = rng.integers(0, len(words))
            words[at : at + rng.integers(0, 2)] = [word()] * rng.integers(0, 2)
        texts.append(words + ([word() for _ in range(rng.integers(15, 25))] if k % 6 == 0 else []))
    texts += [base, base + [word() for _ in range(25)], base + [word() for _ in range(120)], base * 2 + [word() for _ in range(260)]]
    texts = [" ".join(x) for x in texts]
    sets = [word_set(t, 4) for t in texts]
    low = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if low[i] != low[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    turns, star = [], minhash._star
    monkeypatch.setattr(minhash, "_star", lambda *args: turns.append(1) or star(*args))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(rows, width=4, few=32).collect()}
    assert [got[k] for k in range(len(texts))] == low and len(set(low)) > 1
    assert len(turns) <= 2


def test_suffix_tree_on_a_tiny_corpus(spark):
    """Scores against the model written out token by token."""
    lines = ["a b a b a c", "a b a b", "red rare1 rare2 blue", "red rare1 rare2 blue", "b a", "", None] + ["the dog ran"] * 9 + ["the cat ran"] * 3
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, kinds=8, often=4, share=10).collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    copies = [k for k, t in enumerate(lines) if t == "red rare1 rare2 blue" and not held(k)]
    assert all(got[k]["score"] > got[k]["base_score"] for k in copies)
    again = {r["doc_id"]: r for r in suffix_tree.score(docs.repartition(7), kinds=8, often=4, share=10, part_size=3).collect()}
    for k in got:  # however texts and words are dealt out
        assert abs(got[k]["score"] - again[k]["score"]) < 1e-9 and got[k]["n_known"] == again[k]["n_known"]
    assert suffix_tree.score(docs.limit(0)).count() == 0


def test_kind_states_are_distributions():
    rng = np.random.default_rng(3)
    counts = rng.poisson(2.0, (5, 5, 5)).astype(np.float32)
    counts[2] = 0
    spelt = np.array([3.0, 0, 1, 2, 5])
    states = suffix_tree.kind_states(counts, spelt, divergence=1.0)
    root = counts.sum(axis=(0, 1)) + spelt
    root = root / root.sum()
    assert np.allclose((10.0**states * root).sum(axis=-1), 1, atol=1e-5)
    assert np.allclose(states[2], states[2][:, :]) and np.isfinite(states).all()


def test_part_sums_by_hand():
    """One infrequent word that is always followed by one other: a state that predicts it."""
    record = lambda key, nxt, row, held=0: (key, nxt, row, held, 0)
    rows = np.array([record(7, -5, 0), record(7, -5, 1), record(9, suffix_tree.NO_NEXT, 1), record(7, -6, 2, 1)], suffix_tree._RECORD)
    known = {"key": np.array([7, 9]), "known": np.array([1, 0]), "base": np.array([-3.0, -4.0]), "log": np.array([-2.0, -5.0])}
    (out,) = suffix_tree._part_sums([rows.tobytes()], known, np.zeros(1), coldest=-4.0, divergence=3.0)
    sums = np.frombuffer(out, suffix_tree._SUMS)
    seen = np.log10((2 - 0.75 + 0.75 * 1e-4) / 2) + 4
    unseen = np.log10(0.75 / 2)
    assert sums["row"].tolist() == [0, 1, 2] and sums["known"].tolist() == [1, 1, 1]
    assert np.allclose(sums["base"], [-3, -7, -3]) and np.allclose(sums["log"], [-2 + seen, -7 + seen, -2 + unseen])


def test_segments_against_all_segments():
    """Ruzzo and Tompa's definition: no prefix or suffix of a maximal segment falls to or below zero, and none can grow."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        s = rng.normal(-0.2, 1, rng.integers(1, 30)).round(2)
        t = np.r_[0.0, np.cumsum(s)]
        inner = {(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if all(t[a] < t[k] for k in range(a + 1, b + 1)) and all(t[k] < t[b] for k in range(a, b))}
        largest = {(a, b) for a, b in inner if not any((c, d) != (a, b) and c <= a and b <= d for c, d in inner)}
        assert {(a, b) for a, b, _ in toxicity.segments(s)} == largest


def test_segments_take_linear_time():
    falling = np.tile([1.0, -1.5], 200_000)
    assert len(toxicity.segments(falling)) == 200_000


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, module, label):
    docs, labels = labelled(spark, 300)
    odd = [(None, None), (None, ""), (7, "x " * 200_000), (7, "same"), (7, "same"), (-1, "é\U0001f600 " * 50)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("clash") for c in ("id", "y", "r", "stat", "x", "fold", "score", "text_key")})
    got = module.classify(rows, labels).toPandas()
    assert len(got) == rows.count() and got.score.between(0, 1).all()
    assert got[got.doc_id == 7].score.nunique() <= 3 and got.held_out.notna().all()
    assert module.classify(rows.limit(0), labels).count() == 0


def test_sums_by_lots(spark):
    from logweave.llm.common import added

    rows = spark.range(0, 200, 1, 50).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    parts = rows.groupBy(F.spark_partition_id()).agg(F.array(F.sum(F.col("v")[0]), F.sum(F.col("v")[1])).alias("v")).select("v").repartition(40)
    assert added(parts, 2, lot=3).tolist() == [199 * 100.0, 200.0]


def test_long_runs_of_marks():
    v = pieces.Vocabulary.load(pieces.default_model())
    for n in (49, 64, 200):
        word = pieces.MARK * n + "abc"
        parts = list(word)
        while len(parts) > 1:  # the rule, by trial of all pairs
            found = [(-v.scores[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in v.scores]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert v.merged(word) == parts
    assert "".join(v.merged(pieces.MARK * 100_000)) == pieces.MARK * 100_000


def test_vectors_on_odd_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e-9]), (1, [1.0, 1e-9]), (None, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "cls", "n", "tile", "a", "b")})
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(rows).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("3", 0, 3, True), ("None", 2, 1, False)]
    assert vectors.near_vectors(rows.limit(0)).count() == 0


def test_double_vectors_keep_their_precision(spark):
    angle = np.arccos(0.95)
    just = [(0, [1.0, 0.0]), (1, [float(np.cos(angle - 1e-10)), float(np.sin(angle - 1e-10))]), (2, [float(np.cos(angle + 1e-10)), -float(np.sin(angle + 1e-10))])]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark.createDataFrame(just, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def picture(rng):
    blend = np.maximum(1 - np.abs(np.linspace(0, 7, 64)[:, None] - np.arange(8)), 0)
    return blend @ rng.integers(30, 220, (8, 8)) @ blend.T


def test_image_copies_are_found_as_all_pairs_find_them(spark):
    """Of the links that comparing all pairs finds among crops, edits, noise and turns, nine in ten at least."""
    rng = np.random.default_rng(21)
    pics = []
    for _ in range(12):
        p = picture(rng)
        pics += [p, p[4:62, 3:60], p * 0.85 + 15, p + rng.normal(0, 3, p.shape), np.rot90(p), p[2:, 5:] * 1.1]
    pics = [np.ascontiguousarray(np.clip(np.rint(p), 0, 255).astype(np.uint8)) for p in pics]
    found = [images.features(p[None])[0] for p in pics]
    low = list(range(len(pics)))
    for i in range(len(pics)):
        for j in range(i):
            if low[i] != low[j] and images.agreement(found[j], found[i]) >= 8:
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    rows = spark.createDataFrame([(k, *p.shape, p.tobytes()) for k, p in enumerate(pics)], "id bigint, height int, width int, pixels binary")
    got = {r["id"]: r["copy_id"] for r in images.near_images(rows.withColumns({c: F.lit("clash") for c in ("key", "word", "root", "n", "a", "b")})).collect()}
    linked = [k for k in range(len(pics)) if low[k] != k]
    right = sum(got[k] == low[k] for k in linked)
    assert len(linked) > 40 and right >= 0.9 * len(linked)
    assert all(got[k] >= low[k] for k in range(len(pics)))  # and no link that all pairs don't have
    assert images.near_images(rows.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_image_copies_that_no_hub_joins(spark, monkeypatch, block):
    """Without a candidate from the table every link of all pairs is still found, block by block."""
    monkeypatch.setattr(images, "BLOCK", block)
    monkeypatch.setattr(images, "CELLS", 2000)
    rng = np.random.default_rng(22)
    pics = []
    for _ in range(6):
        p = picture(rng)
        pics += [p, p[4:62, 3:60], p + rng.normal(0, 3, p.shape), np.full((64, 64), len(pics))]
    pics = [np.ascontiguousarray(np.clip(np.rint(p), 0, 255).astype(np.uint8)) for p in pics]
    found = [images.features(p[None])[0] for p in pics]
    low = list(range(len(pics)))
    for i in range(len(pics)):
        for j in range(i):
            if low[i] != low[j] and max(images.agreement(found[j], found[i]), images.agreement(found[i], found[j])) >= 8:
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    rows = spark.createDataFrame([(k, *p.shape, p.tobytes()) for k, p in enumerate(pics)], "id bigint, height int, width int, pixels binary")
    got = {r["id"]: r["copy_id"] for r in images.near_images(rows, shared=10**6).collect()}
    assert [got[k] for k in range(len(pics))] == low and len(set(low)) < len(pics) - 8


def test_image_pairs_by_products():
    """All pairs of features, by products: the pairs that agreement() links, ties, equal and opposite descriptors included, in a third of its time at most."""
    rng = np.random.default_rng(23)
    pics = np.stack([np.rint(picture(rng)) for _ in range(150)]).astype(np.uint8)
    found = images.features(pics)
    moved = [f[rng.permutation(len(f))[: rng.integers(6, len(f))]].copy() for f in found[:60]]
    for f in moved:
        turn = rng.integers(0, 4) * 8
        f["turn"] = (f["turn"] + turn) % images.TURNS
        f["x"], f["y"] = [(f["x"], f["y"]), (-f["y"], f["x"]), (-f["x"], -f["y"]), (f["y"], -f["x"])][turn // 8]
        f["x"] += rng.integers(0, 40)
        f["bits"][:, rng.integers(0, 16)] ^= np.uint8(rng.integers(0, 256))
    flat = found[0].copy()
    flat["bits"] = 255  # equal descriptors in equal places' turns
    flat["turn"] = 0
    two = [*moved, flat, np.zeros(0, images.FEATURE)]
    rank = rng.permutation(len(found) + len(two))
    one_rank, two_rank = rank[: len(found)], rank[len(found) :]
    for opposite in (False, True):
        if opposite:
            two[-1] = found[5].copy()
            two[-1]["bits"] = ~two[-1]["bits"]
        began = time.perf_counter()
        got = set(images.alike(found, two, one_rank, two_rank, 8))
        took = time.perf_counter() - began
        began = time.perf_counter()
        linked = {(i, j) for i, a in enumerate(found) for j, b in enumerate(two) if (images.agreement(a, b) if one_rank[i] < two_rank[j] else images.agreement(b, a)) >= 8}
        assert linked <= got and len(linked) >= 40 and len(got) <= len(linked) + 20
        assert opposite or took < (time.perf_counter() - began) / 3
    assert set(images.alike(found[:2], found[:2], np.arange(2), np.arange(2), 8)) == set() and not list(images.alike([], found, np.zeros(0, int), np.arange(150), 8))


def test_chat_chain(spark):
    """A call that uses the result of an earlier one comes after it; a result that came too early stands at its call."""
    call = lambda i: f'{{"tool_calls":[{{"id":"{i}","name":"reply","arguments":{{"text":"t","words":1}}}}]}}'
    result = lambda i: f'{{"tool_call_id":"{i}","content":"done"}}'
    rows = [(1, 0, "user", "go"), (1, 1, "assistant", call("a")), (1, 2, "tool", result("a")), (1, 3, "tool", result("b")), (1, 4, "assistant", call("b")), (1, 5, "assistant", call("c")), (1, 6, "tool", result("c"))]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), chat.REPLY)
    order = [(r["kind"], r["call_id"]) for r in got.orderBy("conv_id", "place", "step", "turn", "seq").collect()]
    assert order == [("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("call", "c"), ("result", "c")]


def test_minhash_sweeps_the_driver(spark):
    """Each turn over crowds collects the driver's garbage, which else fills its heap whatever lives."""
    beans = lambda: {b.getName(): b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()}
    whole = lambda: sum(n for name, n in beans().items() if "Old" in name or "MarkSweep" in name)
    rows = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o p q r s t u v w {k % 2}") for k in range(6)], "doc_id bigint, text string")
    before = whole()
    assert [r["component_id"] for r in minhash.near_duplicates(rows, width=4).orderBy("doc_id").collect()] == [0] * 6
    assert whole() - before >= 3


def test_kinds_of_many_words():
    """Kinds of a list of words, without a table that remembers them, are those of each word."""
    kinds = suffix_tree.Kinds({b"the": 1, b"": 2, b"an": 3}, {b"ng": 4, b"a": 5, b"he": 6})
    words = [b"the", b"", b"an", b"sing", b"ng", b"a", b"he", b"zzz", b"sing", b"the"]
    assert kinds.numbers(words).tolist() == [kinds.of(w) for w in words] == [1, 2, 3, 4, 4, 5, 6, 0, 4, 1]
    assert kinds.numbers([]).tolist() == []
