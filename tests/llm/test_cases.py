"""Defined cases of operators and stages: null and repeated ids, clashing names, empty tables, very
long texts, large groups; toxicity against a plain version."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.llm import chat, common, decontam, htmltext, jaccard, langid, media, packing, substring, tokencount, toxicity

CLASHING = ["n_words", "n_removed", "removed", "kept_text", "toxic_score", "rejected", "row_id", "N_Words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=2, clashing=False):
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], SCHEMA)
    if clashing:
        df = df.select("*", *[F.concat(F.lit(f"mine-{c}-"), F.coalesce(F.substring("text", 1, 3), F.lit("none"))).alias(c) for c in CLASHING[:-1]])
    return common.written(df.repartition(parts), "fixture")


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


ITEM = words("bench", 15)
ROWS = [(None, "x " + ITEM), (None, words("a", 40)), (None, words("a", 40)), (1, words("b", 60)), (1, ITEM + " y"), (1, "clean here"), (2, words("b", 60)), (3, None), (3, ""), (4, words("c", 30) + " " + words("c", 30)), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS, clashing=True)


def kept(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())


def own_values_left(df):
    return all(r[c] == f"mine-{c}-{(r.text or 'none')[:3]}" for r in df.collect() for c in CLASHING[:-1] if r.text)


def test_stages_keep_columns_and_judge_rows(spark, docs):
    bench = spark.createDataFrame([(7, ITEM), (None, words("b", 12))], "item_id long, text string")
    labels = spark.createDataFrame([(None, None, 1)], "doc_id long, quality int, toxic int")
    clean = [(-1 if i is None else i, t or "") for i, t in ROWS]
    got = decontam.stage(docs, bench)
    assert kept(got) == sorted(x for x in clean if "bench" not in x[1] and not x[1].startswith("b0 "))
    one = jaccard.stage(docs, 5, 80)
    # the rows with the item are near copies, as are the two of words("b", 60); empty ones link to nothing
    assert kept(one) == sorted([*(x for x in set(clean) if x[1] and x not in ((2, words("b", 60)), (-1, "x " + ITEM))), *(x for x in clean if not x[1])])
    cut = substring.stage(docs)
    texts = dict((i, t) for i, t in kept(cut) if i == 4)
    assert texts[4] == words("c", 30) and cut.count() == len(ROWS) and sorted(x for x in kept(cut) if x[0] == 2) == [(2, "")]
    fine = toxicity.stage(docs, labels)
    assert kept(fine) == sorted(clean)
    for df in (got, one, cut, fine):
        assert df.columns == docs.columns and own_values_left(df)


def test_results_beside_columns_of_their_names(docs):
    out = substring.removal(docs)
    assert out.columns[-4:] == ["n_words_", "n_removed_", "removed_", "kept_text_"] and own_values_left(out)
    scored = toxicity.score(docs, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0))
    assert scored.columns[-2:] == ["toxic_score_", "rejected_"] and own_values_left(scored)
    assert common.free_name("n_words", ["N_WORDS", "n_words_"]) == "n_words__"


def test_rows_without_id(spark, docs):
    got = jaccard.digest(docs).collect()
    assert len(got) == len(ROWS) and sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 14, 38, 38]
    assert {r.component_id for r in got if r.doc_id is None} == {None} and {r.component_id for r in got if r.doc_id == 2} == {1}
    d = decontam.digest(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in d if r.contaminated) == [(0, 15), (1, 15)]
    assert langid.digest(docs).filter("doc_id is null and not held_out").count() == 4
    assert toxicity.digest(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("doc_id is null and not held_out and predicted = 0").count() == 4
    assert packing.packed(docs).filter("doc_id is null").count() == 4 and media.digest(docs).filter("doc_id is null").count() == 4
    assert tokencount.token_counts(docs).filter("doc_id is null").count() == 4 and substring.digest(docs).filter("doc_id is null").count() == 4


def pipeline_of(spark, path, rows, labels=(), clashing=False):
    import corpus_pipeline as P

    frame(spark, rows, clashing=clashing).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, ITEM)] if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return P.run(spark, str(path)).collect()


def test_pipeline_of_odd_rows(spark, tmp_path):
    got = pipeline_of(spark, tmp_path, ROWS, clashing=True)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, -1, 1, 1, 3, 3, 4]
    assert pipeline_of(spark, tmp_path / "none", []) == []


def test_pipeline_against_plain_stages(spark, tmp_path):
    """All five stages with toxic documents, copies, repeated passages and benchmark windows in them."""
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    passage, rows, labels = text(60), [], []
    for k in range(600):
        own = text(40)
        if k % 6 == 0:
            own += " vilest slander " + text(3)
            labels.append((k, 1, 1))
        elif k % 6 == 1:
            labels.append((k, 1, 0))
        if k % 25 == 2:
            own += " " + passage
        if k % 40 == 3:
            own += " " + ITEM
        if k % 30 == 4 and k > 30:
            own = rows[k - 30][1] + " tail"
        rows.append((k, own))
    got = pipeline_of(spark, tmp_path, rows, labels)
    left = [x for x in rows if x[0] % 6]
    comp = jaccard.brute_force(left, 5, 80)
    left = [x for x in left if comp[x[0]][1] == x[0]]
    gone = {d: n for d, _, n, _ in substring.brute_force(left)}
    dirty = {x[0] for x in decontam.brute_force(left, [(7, ITEM)]) if x[5]}
    assert {p.doc_id for p in got} == {d for d, _ in left} - dirty and len(dirty) > 5 and sum(n > 0 for n in gone.values()) > 10
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    tokens = {p.doc_id: p.doc_tokens for p in got}
    for d, own in left:
        if d in tokens:
            whole = len(t.encode(own, add_special_tokens=False).ids) + 1
            assert tokens[d] < whole if gone[d] else tokens[d] == whole


def test_a_large_group_of_near_copies_is_sent_once(spark):
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:j] + [f"n{k}"] + base[j + 1 :])) for k in range(1500) for j in [r.randrange(120)]]
    rows += [(2000 + k, " ".join(base[:60] + [f"o{j}" for j in range(60)] + [f"m{k}"])) for k in range(5)]
    sets = jaccard.shingles(frame(spark, rows, 4), 3, 80)
    reps = common.written(sets.filter("tokens is not null").select(F.col("doc_id").alias("rep"), "n", "pre", "tokens"), "reps")
    sent = []
    label = {x.id: x.component for x in jaccard.components(jaccard.links_between(reps, 80, 64, sent)).collect()}
    n = reps.count()
    assert {label.get(d, d) for d, _ in rows[:1500]} == {0} and {label.get(d, d) for d, _ in rows[1500:]} == {2000}
    assert sum(sent) < 2 * n


def test_what_leaders_leave_apart_meets_all(spark):
    """Chains of revisions, each near to the next ones only."""
    text, rows, r = [f"w{k}" for k in range(60)], [], random.Random(1)
    for k in range(240):
        text = text[1:] + [f"x{k}"]
        rows.append((k, " ".join(text)))
    ids = r.sample(range(1000), 240)
    rows = [(i, t) for i, (_, t) in zip(ids, rows)]
    reps = common.written(jaccard.shingles(frame(spark, rows), 3, 80).filter("tokens is not null").select(F.col("doc_id").alias("rep"), "n", "pre", "tokens"), "reps")
    label = {x.id: x.component for x in jaccard.components(jaccard.links_between(reps, 80, 16)).collect()}
    assert {d: label.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in jaccard.brute_force(rows, 3, 80).items()}


def plain_toxicity(rows, toxic, prior):
    """The docstring in plain Python, but for the training of the weights: scores by row."""
    split = re.compile(rb"[0-9a-z\x80-\xff]+")

    def terms(t):
        found = split.findall((t or "").encode().lower())
        return frozenset(found) | {(n, w[:n]) for w in found for n in toxicity.STEMS if len(w) > n}

    learnt = [(i, terms(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    p = list(dict.fromkeys(x for i, x in learnt if i in toxic))
    u = list(dict.fromkeys(x for _, x in learnt))
    z = {}
    for w in set().union(*p):
        a, b = sum(w in x for x in p), sum(w in x for x in u)
        both = (a + b) / (len(p) + len(u))
        if a >= 3:
            z[w] = abs(a / len(p) - b / len(u)) / math.sqrt(both * (1 - both) * (1 / len(p) + 1 / len(u)) + 1e-12)
    strong = [w for w in z if z[w] >= max(toxicity.MIN_Z, toxicity.LEAST_SHARE * max(z.values()))]
    table = lambda texts: np.array([[w in x for w in strong] for x in texts], np.float32)
    weights, bias = toxicity.train(table(p), table(u), prior)
    return [1 / (1 + math.exp(-(bias + sum(v for w, v in zip(strong, weights) if w in terms(t))))) for _, t in rows]


def test_toxicity_against_a_plain_version(spark):
    r = random.Random(2)
    rows = []
    for k in range(700):
        t = [f"word{r.randrange(200)}" for _ in range(25)] + (["Vilest" + r.choice(["", "a", "é"]), r.choice(["scum", "word1"])] if k % 7 == 0 else [])
        r.shuffle(t)
        rows.append((k, " ".join(t)))
    rows += [(900, ""), (901, None), (902, "vilest " * 60_000), (3, rows[3][1])]
    marks = [(k, 0, int(k % 7 == 0)) for k in range(0, 700, 2)] + [(14, 0, 0), (7, 1, None)]
    toxic = {k for k, _, x in marks if x == 1}
    known = {k for k, _, x in marks if x is not None and zlib.crc32(str(k).encode()) % 5}
    want = plain_toxicity(rows, toxic, len(known & toxic) / len(known))
    got = toxicity.digest(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert sorted((x.doc_id, round(x.score, 2)) for x in got) == [(i, pytest.approx(s, abs=0.02)) for i, s in sorted(zip([i for i, _ in rows], want))]
    assert [x.predicted for x in got if x.doc_id == 902] == [1]


def test_the_gradient_is_that_of_the_risk():
    r = np.random.default_rng(3)
    p, u = (r.random((20, 4)) < 0.5).astype(np.float32), (r.random((60, 4)) < 0.3).astype(np.float32)
    sig = lambda f: 1 / (1 + np.exp(-f))

    def risk(w, prior):
        fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        return prior * sig(-fp).mean() + max(0.0, sig(fu).mean() - prior * sig(fp).mean())

    prior = 0.3
    start = risk(np.zeros(5), prior)
    trained = risk(np.append(*toxicity.train(p, u, prior, steps=300)), prior)
    best = min(risk(r.normal(0, 3, 5), prior) for _ in range(3000))
    assert trained < start and trained < best + 0.02


def test_very_long_texts(spark):
    long = words("lang", 150_000)
    df = frame(spark, [(1, long), (2, long + " end"), (3, "short")])
    assert {r.component_id for r in jaccard.digest(df).collect()} == {1, 3}
    assert {r.doc_id: r.n_removed for r in substring.digest(df).collect()} == {1: 0, 2: 150_000, 3: 0}
    bench = spark.createDataFrame([(7, words("lang", 12))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontam.digest(df, bench).collect()} == {1: 12, 2: 12, 3: 0}
    assert {r.n_words for r in tokencount.token_counts(df).collect()} == {150_000, 150_001, 1}
    assert langid.digest(df).count() == 3 and media.digest(df).count() == 3 and packing.packed(df).filter("doc_id = 3").count() == 1
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>menu</p><p>{long} {k}</p>" + "<p>x</p>" * 3000) for k in range(2)], "page_id long, url string, html string")
    assert [r.n_chars for r in htmltext.digest(pages).orderBy("page_id").collect()] == [len(long) + 2] * 2
    said = spark.createDataFrame([(1, k, "assistant", long) for k in range(2)], "conv_id long, turn long, role string, text string")
    assert chat.digest(said).filter("conv_id = 1").first().loss_chars == 2 * len(long)


def test_common_words_and_many_windows(spark, monkeypatch):
    monkeypatch.setattr(decontam, "STEP", 64)
    rows = [(k, "the " * (30 + k)) for k in range(20)] + [(50, words("a", 30))]
    items = [(1, "the " * 10), (2, words("a", 11)), (3, "the")]
    got = sorted(tuple(r) for r in decontam.digest(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted(decontam.brute_force(rows, items))
