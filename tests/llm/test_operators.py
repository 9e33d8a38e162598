"""Training-data operators against brute force on small fixtures and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarifa.llm import chat, common, decontam, htmltext, jaccard, langid, media, packing, pieces, substring, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hashes string, row_id string"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, odd white space, nulls and repeated rows."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "ab cd ef gh ij".split() for b in ("", "x", "yé", "Z")]
    passage = [rng.choice(words) + str(k) for k in range(55)]
    out = []
    for k in range(n):
        w = [rng.choice(words) + str(rng.randrange(900)) for _ in range(rng.choice([0, 1, 2, 3, 9, 25, 90]))]
        if k % 5 == 0:
            w = w + passage + w[:3]
        if k % 7 == 0 and out:
            w = (out[rng.randrange(len(out))][1] or "").split(" ")
        if k % 14 == 0 and len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        out.append((k, None if k == 13 else rng.choice([" ", " ", "\n "]).join(w)))
    return out + [(100, "x " * 400), (101, "one two"), (102, "one two"), (103, ""), (104, "　 "), (5, out[5][1])]


def frame(spark, rows, parts=3):
    return common.written(spark.createDataFrame([(i, t, "en", "s", len(t or ""), "h", "r") for i, t in rows], DOCS).repartition(parts), "fixture")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [], 1)


def test_word_hashes_and_windows():
    texts = ["a b", "", None, "b  a\tc", "Ä" * 5000 + " z", "a b"]
    raw, off = common.text_bytes(pa.array(texts))
    s, e, first = common.words(raw, off, common.ASCII_SPACE)
    assert np.diff(first).tolist() == [2, 0, 0, 3, 2, 2]
    h = common.word_hashes(raw, s, e)
    assert h[0] == h[3] == h[7] and h[1] == h[2] == h[8] and len(set(h.tolist())) == 5
    values = np.arange(50, dtype=np.uint64) % np.uint64(7)
    w = common.rolling(values, 7)
    assert len(w) == 44 and all(w[i] == w[i + 7] for i in range(37)) and len(set(w.tolist())) == 7


def test_squeeze_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 999).astype(np.uint64))
    assert (common.unsqueeze(common.squeeze(x), 999) == x).all()
    edges = common.bucket_edges(x, 5)
    assert edges[0] == 0 and edges[-1] == 999 and all(int(v) * 5 >> 64 == b for b in range(5) for v in x[edges[b] : edges[b + 1]])


def test_substring_dedup(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in substring.digest(docs).collect())
    assert got == sorted(substring.brute_force(rows))
    assert sum(r[2] for r in got) > 100
    assert substring.digest(empty).count() == 0
    kept = {r.doc_id: r for r in substring.stage(docs).collect()}
    assert kept[101].text == "one two" and kept[13].text is None and set(substring.stage(docs).columns) == set(docs.columns)
    spans = substring.removal(docs).filter("doc_id = 100").first()
    assert spans.removed == [[1, 400]]


def test_substring_rejects_other_rows_in_the_second_pass(spark, docs):
    noise = F.udf(lambda: f" {random.SystemRandom().random()}").asNondeterministic()
    with pytest.raises(Exception, match="other rows"):
        substring.digest(docs.withColumn("text", F.concat("text", *[noise()] * 20))).collect()


def test_decontamination(spark, docs, rows, empty):
    text = dict(rows)
    passage = text[0].split()
    items = [(1, " ".join(passage[-30:-8])), (2, " ".join(passage[-9:-4]).upper()), (10, "no such words at all here today or tomorrow ever again"), (3, ""), (4, None), (5, " ".join(passage[-30:-8]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontam.brute_force(rows, items))
    assert sorted(tuple(r) for r in decontam.digest(docs, bench).collect()) == want and any(r[5] for r in want)
    single = {(r.row_id): (r.n_hit, sorted(r["items"])) for r in decontam.matches(docs, bench).collect()}
    blocks = {(r.row_id): (r.n_hit, sorted(r["items"])) for r in decontam.matches(docs, bench, block_words=20).collect()}
    assert single == blocks
    assert decontam.digest(empty, bench).count() == 0
    assert decontam.digest(docs, bench.limit(0)).filter("contaminated").count() == 0
    clean = {r.doc_id for r in decontam.stage(docs, bench).collect()}
    assert clean == {r[0] for r in want if not r[5]}


def test_proximity(spark):
    d = frame(spark, [(1, "a q b c d e"), (2, "c b a d e"), (3, "a b c d x x x e")], 1)
    b = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    near = lambda slop: sorted((r.doc_id, r.start, r.end) for r in decontam.proximity_matches(d, b, slop).collect())
    assert near(0) == [(2, 0, 5)] and near(1) == [(1, 0, 6), (2, 0, 5)] and near(3) == [(1, 0, 6), (2, 0, 5), (3, 0, 8)]


def test_ngram_join(spark, docs, rows, empty):
    unique = list({i: (i, t) for i, t in reversed(rows)}.values())
    want = jaccard.brute_force(unique)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.digest(docs).collect()}
    assert got == want and sum(c != d for d, (_, c) in want.items()) > 5
    assert jaccard.digest(empty).count() == 0
    assert {r.doc_id for r in jaccard.stage(docs).collect()} == {d for d, (_, c) in want.items() if c == d}


def test_ngram_join_of_large_groups_in_blocks(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"n{k}"
        rows.append((k, " ".join(w)))
    sets = jaccard.shingles(frame(spark, rows))
    reps = common.written(sets.filter("tokens is not null").select(F.col("doc_id").alias("rep"), "n", "pre", "tokens"), "reps")
    label = {r.id: r.component for r in jaccard.components(jaccard.links_between(reps, block=16)).collect()}
    assert {d: label.get(d, d) for d, _ in rows} == {d: c for d, (_, c) in jaccard.brute_force(rows).items()}


def test_trie_walk_against_all_pairs():
    for trial in range(150):
        r = random.Random(trial)
        base = [r.sample(range(400), r.randint(3, 40)) for _ in range(3)]
        sets = []
        for _ in range(r.randint(2, 20)):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 4)):
                s ^= {r.randrange(400)}
            sets.append(s or {1})
        n = np.array([len(s) for s in sets])
        side = np.array([r.randint(0, 1) if trial % 2 else 0 for _ in sets])
        one = len(set(side.tolist())) == 1
        links = jaccard.trie_links([np.array(sorted(s), "<u8") for s in sets], n, side, 80)

        def parts(edges):
            p = list(range(len(sets)))
            for a, b in edges:
                a, b = p[a], p[b]
                p = [min(a, b) if x in (a, b) else x for x in p]
            return p

        true = [(i, j) for i in range(len(sets)) for j in range(i) if (one or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert parts(links) == parts(true)


def test_packing(spark, rows, empty):
    docs = frame(spark, rows + [(200, "abc " * 5000), (201, "<|endoftext|> it's 3.5 naïve ΑΣ ①")])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for d, x in [*rows, (200, "abc " * 5000), (201, "<|endoftext|> it's 3.5 naïve ΑΣ ①")])
    got = [r.asDict() for r in packing.packed(docs, keep_ids=True).collect()]
    lanes: dict[int, list] = {}
    for p in got:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        lanes.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(lanes) == -(-sum(len(i) for _, i in want) // 4096)
    for d in {d for d, _ in want}:
        if sum(x == d for x, _ in want) == 1:
            own = sorted((p["start"], p["ids"]) for p in got if p["doc_id"] == d)
            assert tuple(x for _, ids in own for x in ids) == dict(want)[d]
    assert packing.packed(empty).count() == 0


def test_closest_fill_against_all_subsets():
    for trial in range(200):
        r = random.Random(trial)
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        capacity = r.randint(0, 80)
        sums = {0}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(1, n + 1)}
        fill = packing.closest_fill(counts, capacity)
        assert sum(k * n for k, n in fill.items()) == max(s for s in sums if s <= capacity)
        assert all(n <= counts[k] for k, n in fill.items())


def test_ids_of_shared_words_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordEncoder(packing.tokenizer_path(), limit=50)
    r = random.Random(2)
    chars = "abcdeéüßÀaa0123!!..,-$%&+/:@[]^_~ABCxyz\x01ÀΣα千½'<|>"
    texts = [" ".join("".join(r.choice(chars) for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += ["", " \n\t", "it's <|endoftext|> a<|endoftext|>b \x01 \x01", "e\u0301 \u0301 x\u00a0y", "x" * 5000]
    assert own.mark is not None
    for at in range(0, len(texts), 40):
        ids, off = own.encode(texts[at : at + 40])
        for k, t in enumerate(texts[at : at + 40]):
            assert ids[off[k] : off[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_language_id(spark, empty):
    r = random.Random(1)
    kinds = {"en": "the and of thing with from", "de": "der und nicht sich über schön", "fr": "le et dans être avec pour"}
    rows = [(k, " ".join(r.choice(kinds[lang].split()) for _ in range(12)), lang) for k, lang in enumerate(list(kinds) * 40)] + [(900, None, "en"), (901, "12 !?", "en"), (902, "nichtlich überschön", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "", "") for i, t, lang in rows], DOCS)
    got = {x.doc_id: x for x in langid.digest(docs).collect()}
    assert all(got[i].lang_pred == lang for i, t, lang in rows[:120]) and got[902].lang_pred == "de"
    assert (got[900].lang_pred, got[901].lang_pred, got[900].score) == ("und", "und", 0.0)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x.score <= 1 for i, x in got.items())
    assert langid.digest(empty).count() == 0
    assert {x.lang_pred for x in langid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def langid_model(counts):
    """The model of (lang, word): n, with n-grams counted one by one."""
    grams: dict = {}
    for (lang, word), n in counts.items():
        for size in range(1, langid.LONGEST + 1):
            for g in langid.grams_of(word, size):
                if g != " ":
                    grams[lang, g] = grams.get((lang, g), 0) + n
    table = lambda found: pa.table({"lang": [k[0] for k in found], "key": [k[1] for k in found], "n": list(found.values())})
    return langid.Model(table(counts), table(grams))


def test_word_backoff():
    m = langid_model({("en", "thing"): 5, ("en", "nothing"): 5, ("de", "schön"): 5, ("de", "once"): 1})
    assert m.score("thing").argmax() == m.langs.index("en") and m.score("schöne").argmax() == m.langs.index("de")
    assert "once" not in m.words and m.score("千").tolist() == [0, 0]


def brute_force_language(train, texts):
    """The contract of the docstring in plain Python: (lang, score) of each text."""
    import unicodedata

    def words(t):
        return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (t or "").lower()).split()

    langs = sorted({lang for lang, t in train if words(t)})
    known = [{} for _ in range(7)]  # by n; place 6 has whole words
    for lang, t in train:
        for w in words(t):
            for n, key in [(6, w), *((n, f" {w} "[a : a + n]) for n in range(1, 6) for a in range(len(w) + 3 - n))]:
                if key != " ":
                    known[n].setdefault(key, [0] * len(langs))[langs.index(lang)] += 1
    known[6] = {w: n for w, n in known[6].items() if sum(n) > 1}
    total = [[sum(v[k] + 0.5 for v in level.values()) or 1 for k in range(len(langs))] for level in known]
    logs = lambda n, v: np.array([np.log((x + 0.5) / total[n][k]) for k, x in enumerate(v)])

    def score(w):
        if w in known[6]:
            return logs(6, known[6][w])
        for n in range(5, 0, -1):
            found = [logs(n, known[n][g]) for a in range(len(w) + 3 - n) if (g := f" {w} "[a : a + n]) in known[n]]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        own = words(t)
        if not own or not langs:
            out.append(("und", 0.0))
            continue
        sums = sum(score(w) for w in own)
        out.append((langs[int(sums.argmax())], float(1 / np.exp((sums - sums.max()) / np.sqrt(len(own))).sum())))
    return out


def test_language_id_against_brute_force(spark):
    r = random.Random(7)
    kinds = {"en": "the and of thing with from nothing ½x", "de": "der und nicht sich über schön straße", "ja": "これは ペン です 千"}
    rows = [(k, " ".join(r.choice(kinds[lang].split()) + r.choice(["", "", "s", "lich", "2", "_"]) for _ in range(r.randint(1, 9))), lang) for k, lang in enumerate(list(kinds) * 30)]
    rows += [(500, "½ ² ① Ⅷ", "en"), (501, "Ⅷa", None), (502, "über " * 30_000, "de"), (503, "e\u0301te", "de"), (504, "千", None), (505, "\U00010330", None), (None, "nothing", None), (0, rows[0][1], "en"), (0, rows[0][1], "en")]
    df = spark.createDataFrame([(i, t, lang, "s", 0, "", "") for i, t, lang in rows], DOCS).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x")).repartition(3)
    learnt = [(lang, t) for i, t, lang in rows if lang and (i is None or zlib.crc32(str(i).encode()) % 5)]
    want = sorted((-1 if i is None else i, lang, pytest.approx(s, abs=1e-4)) for (i, t, _), (lang, s) in zip(rows, brute_force_language(learnt, [t for _, t, _ in rows])))
    got = langid.digest(df).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.lang_pred, x.score) for x in got) == want
    assert {x.lang_pred for x in got if x.doc_id in (500,)} == {"und"} and all(x.held_out is not None for x in got)


def test_toxicity(spark, empty):
    r = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1200):
        bad = k % 8 == 0
        t = [r.choice(words) for _ in range(30)] + (["vilest" + r.choice(["", "a", "b"])] if bad else [])
        r.shuffle(t)
        rows.append((k, " ".join(t)))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    docs = frame(spark, rows + [(5000, None), (5001, "")])
    marks = spark.createDataFrame(labels + [(9999, 0, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.digest(docs, marks).collect()}
    held = [x for i, x in got.items() if x.held_out and i < 1200]
    assert np.mean([x.predicted == int(x.doc_id % 8 == 0) for x in held]) > 0.97
    assert got[5000].score == got[5001].score < 0.5 and all(x.predicted == int(x.score >= 0.5) for x in got.values())
    assert max(x.score for x in toxicity.digest(docs, marks.filter("toxic = 0")).collect()) < 1e-6
    assert toxicity.digest(empty, marks).count() == 0
    kept = {x.doc_id for x in toxicity.stage(docs, marks).collect()}
    assert kept == {i for i, x in got.items() if not x.predicted}


def test_nonnegative_risk_learns_from_positives_and_a_mixture():
    r = np.random.default_rng(0)
    p = (r.random((200, 3)) < [0.9, 0.1, 0.5]).astype(np.float32)
    u = np.concatenate([(r.random((100, 3)) < [0.9, 0.1, 0.5]), (r.random((900, 3)) < [0.02, 0.6, 0.5])]).astype(np.float32)
    w, b = toxicity.train(p, u, 0.1)
    assert w[0] > 1 > w[2] > -1 and (p @ w + b > 0).mean() > 0.8 and (u[100:] @ w + b > 0).mean() < 0.05


def test_token_counts(spark, docs, rows, empty):
    scores, byte = tokencount.piece_scores(tokencount.vocabulary_path())
    got = sorted((x.doc_id, x.n_words, x.n_tokens, x.score) for x in tokencount.token_counts(docs).collect())
    want = []
    for i, t in rows:
        each = [tokencount.brute_force(w, scores, byte) for w in (t or "").split()]
        want.append((i, len(each), sum(n for n, _ in each), pytest.approx(sum(s for _, s in each), abs=1e-5)))
    assert got == sorted(want, key=lambda x: x[:3])
    count = tokencount.Counter(scores, byte)
    assert count(["token", "tokens", "tokenise", "😀"])[1] == len("▁token") + 1 + 3 + 1
    assert tokencount.token_counts(empty).count() == 0
    own = {x.doc_id: (x.n_words, x.n_tokens, x.score) for x in tokencount.token_counts(docs, scores=({"▁": -1.0, "one": -2.0}, -5.0)).collect()}
    assert own[101] == (2, 6, -1.0 - 2.0 - 1.0 - 15.0)  # ▁ one ▁ t w o


def test_every_distinct_word_is_computed_once():
    """Words of several runs meet those that begin alike in one bucket, each once."""
    words = [[f"word{k % (400 + r)}" for k in range(500)] + ["the"] for r in range(4)]
    own = [list(dict.fromkeys(w)) for w in words]
    sent = pa.Table.from_batches([pieces.sent_words(f"r{r}", w, 9, tokencount.BEGINNING) for r, w in enumerate(own)])
    buckets = set(sent["bucket"].to_pylist())
    assert len(buckets) <= 2  # "word" and "the"
    seen = []
    count = tokencount.Counter({"▁": -1.0, "word": -2.0}, -3.0)
    spy = lambda w: seen.extend(w) or count(w)
    for b in buckets:
        tokencount._answered(spy, sent.take(np.flatnonzero(np.asarray(sent["bucket"]) == b)))
    assert len(seen) == len(set(seen)) == len({w for x in own for w in x})


def test_media(spark, rows, empty):
    docs = frame(spark, rows + [(300, "long " * 9000), (301, "long " * 9000 + "end")], 4)
    want = set()
    for i, t in [*rows, (300, "long " * 9000), (301, "long " * 9000 + "end")]:
        raw = (t or "").encode()
        p = media.payload(raw)
        m = media.to_media(p)
        assert media.from_media(m) == p and len(p) % 64 == 0 and p
        want.add((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    got = media.digest(docs).collect()
    assert {tuple(x)[:7] for x in got} == want and len(got) == len(rows) + 2
    store = media.Store(docs)
    n = {x.what: x.n for x in store.chunk_counts().collect()}
    assert n["listed"] > n["stored"] and store.shared.count() > 0 and store.exported().count() > 0
    assert media.digest(empty).count() == 0 and not [t for t in spark.catalog.listTables() if t.name.startswith("media_")]


def test_the_store_holds_every_chunk_once(spark, monkeypatch):
    """Near-equal long texts in containers of their own: bodies are stored once, and containers need each other's."""
    r = random.Random(8)
    base = [f"{r.randrange(10**9)}" for _ in range(30_000)]
    texts = [" ".join(base[: 500 * k] + [f"own {k}"] + base[500 * k :]) for k in range(8)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(90, texts[3])]
    monkeypatch.setattr(common, "CHUNK_BYTES", 1 << 16)
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("cont", F.lit("mine")).withColumn("m", F.lit(1)), "fixture")
    store = media.Store(docs)
    chunks = {}
    for t in texts:
        m = media.to_media(media.payload(t.encode()))
        ends = media.chunk_ends(m)
        chunks |= {hashlib.sha256(m[a:b]).digest(): b - a for a, b in zip([0, *ends], ends)}
    n = {x.what: x.n for x in store.chunk_counts().collect()}
    assert store.table.count() > 5 and n["stored"] == len(chunks) and n["bytes"] == sum(chunks.values()) < 0.3 * n["listed"] * n["bytes"] / n["stored"]
    assert sorted(x.doc_id for x in store.documents().collect()) == [*range(8), 90]
    monkeypatch.setattr(media.Store, "exported", lambda self: spark.createDataFrame([], "digest binary, bytes binary"))
    with pytest.raises(Exception, match="chunks of stored media are missing"):
        store.read().collect()


def test_cuts_follow_the_content():
    r = random.Random(3)
    a = bytes(r.randrange(256) for _ in range(40000))
    ends = media.chunk_ends(a)
    assert ends[-1] == len(a) and max(np.diff([0, *ends])) <= media.MOST
    chunk = lambda x: {x[s:e] for s, e in zip([0, *media.chunk_ends(x)], media.chunk_ends(x))}
    assert len(chunk(a) & chunk(b"more" + a)) > 0.8 * len(ends)


def test_html(spark):
    nav = "<div>Home</div><div>About &amp; us</div>"
    page = lambda k: f"<body>{nav}<p>text {k}<br>one</p><p>more {k}</p><script>x</script><div>Imprint</div>"
    rows = [(k, f"http://h.example/a/{k}", page(k)) for k in range(4)]
    rows += [(9, "http://x.example/", "<div>alone</div>"), (10, None, None), (11, "odd", ""), (12, "http://y.example/1", page(7)), (13, "http://y.example/2", page(7))]
    rows += [(14, "http://h.example/b", "<nav>N<article><h1>T&eacute;</h1><p>a <b>b\n c</b></p><aside>s</aside><div class='comments'><p>c</p></div><form>f</form></article><footer>F</footer>")]
    got = {r.page_id: r.text for r in htmltext.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(4)] == [f"text {k} one\n\nmore {k}" for k in range(4)]
    assert (got[9], got[10], got[11], got[14]) == ("alone", "", "", "Té\n\na b c")
    assert got[12] == got[13] and "text 7 one" in got[12]  # copies of each other lose nothing
    assert htmltext.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_only_hidden_elements_and_named_parts_are_dropped():
    text = lambda attributes, outer="article": " ".join(htmltext.page_blocks(f"<{outer}><div {attributes}>in</div><p>out</p></{outer}>")[0])
    for kept in ('style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'title="a hidden valley"', "data-x='display:none'", 'class="post-header"', 'id="related-work"'):
        assert text(kept) == "in out", kept
    for gone in ("hidden", 'hidden=""', "aria-hidden=true", 'style="color:red; display : none"', "class='ad'", "class='ad banner'", "role=navigation", 'style=x hidden'):
        assert text(gone) == "out", gone
    for kept in ("class='nav-free'", "class='blog share'", 'class="post-header"', "class='entry-header'", "title=it's"):
        assert text(kept, "section") == "in out", kept
    assert htmltext.page_blocks('<article class="related-work"><p>a</p></article>') == (["a"], [True])


def test_odd_markup():
    blocks = lambda html: htmltext.page_blocks(html)[0]
    assert blocks('<div class="entry-header"><h1>T</h1></div>') == ["T"] and blocks("<p title=it's>x</p>") == ["x"]
    assert blocks("<title>never closed<p>a") == ["a"] and blocks("<title>t</title>a") == ["a"] and blocks("a<script>b") == ["a"]
    assert blocks('<p data-x="a > b">c</p> d < e') == ["c", "d < e"] and blocks('<a title="open>x</a>y') == ["xy"]
    assert blocks("<p class=ad>x<p>y") == ["y"] and blocks("<ul><li class=ad>x<li>y</ul>z") == ["y", "z"] and blocks("<ul><li class=ad>x</ul>z") == ["z"]
    assert blocks("<aside><article>r</article></aside><article>a</article>") == ["a"] and blocks("<nav>n<article>a</article>") == ["a"]
    assert blocks("<article>a<div class=ad>x</article><p>b") == ["a", "b"] and blocks("<nav/>a") == ["a"]
    assert blocks("<a " + '=""' * 50_000) == ["<a " + '=""' * 50_000]


def test_every_page_with_a_neighbour_is_differenced(spark):
    r = random.Random(3)
    menu = "".join(f"<div>Menu {j}</div>" for j in range(4))
    pages = []
    for k in range(120):
        body = "".join(f"<p>{r.choice(['once', 'often', 'own'])} {r.choice([k, k // 2, 1])}</p>" for _ in range(r.randint(0, 5)))
        wrap = r.choice(["{}", "<article>{}</article>", "<main><p>Notice</p>{}</main>"]).format(body)
        pages.append((k, f"https://h{r.choice([1, 1, 1, 2, 3])}.example/{r.choice('abc')}/{r.randrange(30)}{r.choice(['', '?q=1'])}", r.choice([menu, menu, ""]) + wrap))
    pages += [(500, None, menu), (501, "odd", None), (502, "http://alone.example/", menu), (503, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("x")).repartition(3)
    got = {x.page_id: x.text for x in htmltext.digest(df).collect()}
    assert got == htmltext.brute_force(pages) and got[502].startswith("Menu 0")
    cuts = htmltext._cut_pages(df)
    first = htmltext.representatives(cuts.select(F.explode("keys").alias("k")).select("k.*").filter(F.size("lines") > 0)).collect()
    with_rival = {x.row_id for x in first if sum(y.host == x.host for y in first) > 1}
    near = htmltext.nearest(spark.createDataFrame(first)).collect()
    assert {x.row_id for x in near if x.nth == 0} == with_rival and len(with_rival) > 60


def test_long_pages_are_aligned_in_halves(monkeypatch):
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 30))] for _ in range(2))
        whole = htmltext.shared_lines(a, b).sum()
        monkeypatch.setattr(htmltext, "ALIGN_BITS", 16)
        halves = htmltext.shared_lines(a, b)
        monkeypatch.undo()
        assert halves.sum() == whole
        rest = iter(b)
        assert all(x in rest for x, k in zip(a, halves) if k)


def html_texts(spark, pages):
    rows = [(k, f"http://h.example/{path}", page) for k, (path, page) in enumerate(pages)]
    got = {r.page_id: r.text for r in htmltext.digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    return [got[k].split("\n\n") for k in range(len(pages))]


def test_site_lines_go_from_articles_and_near_copies_stay(spark):
    page = lambda k: f"<article><p>Our site moves in May</p><p>own text {k} of this very article</p><p>and more of it {k}</p></article><p>outside {k}</p>"
    want = lambda k: [f"own text {k} of this very article", f"and more of it {k}", f"outside {k}"]
    assert html_texts(spark, [(f"a/{k}", page(k)) for k in range(5)]) == [want(k) for k in range(5)]
    # two or three articles that have a sentence in common keep it
    assert html_texts(spark, [(f"a/{k}", page(k)) for k in range(3)]) == [["Our site moves in May", *want(k)] for k in range(3)]
    near = lambda k: f"<div>Menu</div><main><p>a long line of the article that is revised</p><p>revision {k}</p></main>"
    assert html_texts(spark, [(f"a/{k}", near(k)) for k in range(9)]) == [["a long line of the article that is revised", f"revision {k}"] for k in range(9)]


def test_boilerplate_without_telling_tags_goes_and_articles_stay(spark):
    """Pages of plain div elements: menu, notice and imprint of a site, texts that now and then share a sentence."""
    r = random.Random(9)
    pages, want = [], []
    for k in range(60):
        host = k % 3
        own = [f"sentence {r.randrange(10**6)} of page {k}" for _ in range(r.randint(1, 6))]
        if k % 7 == 0:
            own.insert(0, "a proverb that some texts quote")
        lines = [f"Menu {host}", "Home", f"Notice: closed on {host}", *own, f"Imprint of {host}"]
        pages.append((k, f"http://s{host}.example/{k // 9}/{k}", "".join(f"<div>{x}</div>" for x in lines)))
        want.append("\n\n".join(own))
    got = {x.page_id: x.text for x in htmltext.digest(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[k] for k in range(60)] == want and got == htmltext.brute_force(pages)


def test_given_pages_against_another_parser(spark):
    """Every page of the smallest table: equal to the plain version, and no line of an article is lost."""
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    rows = [tuple(x) for x in pages.select("page_id", "url", "html").collect()]
    got = {x.page_id: x.text for x in htmltext.digest(pages).collect()}
    assert got == htmltext.brute_force(rows)
    for page, _, html in rows:
        blocks, inside = htmltext.page_blocks(html or "")
        assert got[page] == "\n\n".join(x for x, own in zip(blocks, inside) if own)


def test_short_texts_and_copies_lose_the_menu(spark):
    menu = "".join(f"<div>Menu {j}</div>" for j in range(10))
    short = [(f"a/{k}", f"{menu}<p>one {k}</p><p>two {k}</p>") for k in range(2)]
    copies = [(f"b?q={k}", f"{menu}<p>copied</p>") for k in range(5)]
    assert html_texts(spark, short + copies) == [["one 0", "two 0"], ["one 1", "two 1"], *[["copied"]] * 5]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = [x for x, k in zip(a, htmltext.shared_lines(a, b)) if k]
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(x in rest for x in found)


def test_chat(spark):
    rows = [(1, 0, "user", "a [INST] \\ </s> <<SYS>>"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 2, None, None), (2, 5, "tool]", "y\\"), (2, None, "system", " z "), (None, 0, "assistant", "[ANS] ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    said = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == said([("user", rows[0][3]), ("assistant", "x"), ("assistant", "x"), ("", "")]) and got[1].loss_chars == 2
    assert got[2].turns_sha256 == said([("system", " z "), ("tool]", "y\\")]) and got[None].loss_chars == 6
    tail = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == said([("user", tail), ("assistant", tail)]) and got[-7].loss_chars == len(tail)
    assert chat.digest(df.limit(0)).count() == 1


def test_reply_trees(spark):
    nodes = [("a", 1, None, "q", 0.0), ("a", 2, 1, "x", 1.0), ("a", 3, 1, "y", 2.0), ("a", 4, 3, "z", 0.5), ("b", 1, 9, "o", 0.0), ("c", 1, 2, "", 0.0), ("c", 2, 1, "", 0.0), ("c", 3, 2, "t", 0.0)]
    nodes += [("d", k, k - 1 if k else None, str(k), 0.0) for k in range(70)]
    df = spark.createDataFrame([(t, n, p, "user", x, s) for t, n, p, x, s in nodes], "tree string, node int, parent int, role string, text string, score double")
    got = {(r.tree, r.branch): [t for _, t in chat.parse(r.formatted)] for r in chat.conversations(df, 2).collect()}
    assert got == {("a", 1): ["q", "y", "z"], ("a", 2): ["q", "x"], ("b", 1): ["o"], ("d", 1): [str(k) for k in range(70)]}


def test_odd_reply_trees(spark):
    nodes = [("a", 1, None, "q"), ("a", 1, None, "q"), ("a", 1, None, "r"), ("a", 2, 1, "x"), ("a", None, 1, "y"), ("a", None, 1, "y"), (None, 1, None, "n"), (None, 2, 1, "m")]
    df = spark.createDataFrame([(t, n, p, "user", x, 7) for t, n, p, x in nodes], "tree string, node int, parent int, role string, text string, leaf int")
    got = sorted((r.tree or "", [t for _, t in chat.parse(r.formatted)]) for r in chat.conversations(df, 9).collect())
    assert got == [("", ["n", "m"]), ("a", ["q", "x"]), ("a", ["q", "y"]), ("a", ["q", "y"]), ("a", ["r"])]
    assert chat.conversations(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(50, 3), (3, 40), (7, 8)], "u long, v long")
    got = {r.id: r.component for r in jaccard.components(edges).collect()}
    assert got[10] == got[40] == got[50] == 3 and got[8] == 7


def test_components_of_long_shuffled_paths(spark):
    r = random.Random(5)
    ids = r.sample(range(10_000), 800)
    links = [*zip(ids[:400], ids[1:400]), *((v, u) for u, v in zip(ids[400:], ids[401:])), (20_000, 20_000)]
    got = {x.id: x.component for x in jaccard.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == dict.fromkeys(ids[:400], min(ids[:400])) | dict.fromkeys(ids[400:], min(ids[400:])) | {20_000: 20_000}
    assert jaccard.components(spark.createDataFrame([], "u long, v long")).count() == 0
    with pytest.raises(RuntimeError):
        jaccard.components(spark.createDataFrame(links, "u long, v long"), most=1)


def test_pipeline_links_copies_with_words_appended(spark):
    import corpus_pipeline as P

    words = [f"w{k}" for k in range(228)]
    rows = [(1, " ".join(words[:200])), (2, " ".join(words)), (3, " ".join(words[150:]))]  # 0.875 of five-word n-grams
    assert {r.doc_id for r in P.keep_one_near_copy(spark, frame(spark, rows), "").collect()} == {1, 3}
    assert {r.component_id for r in jaccard.digest(frame(spark, rows)).collect()} == {1, 2, 3}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rows = corpus(3)[:-1]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = [(1, " ".join((dict(rows)[20] or "").split()[-20:]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(P.STAGES), P.ORACLE_SQL] == [5, None]
    got = P.run(spark, str(tmp_path)).collect()
    comp = jaccard.brute_force(rows)
    left = [(d, t) for d, t in rows if comp[d][1] == d]
    gone = {d: (t, r) for (d, t), r in zip(left, substring.brute_force(left))}
    cut = []
    for d, (t, r) in gone.items():
        cut.append((d, t, r))
    from_stage = {r.doc_id: r.text for r in substring.stage(frame(spark, left)).collect()}
    dirty = {r[0] for r in decontam.brute_force(list(from_stage.items()), bench) if r[5]}
    assert {p.doc_id for p in got} == set(from_stage) - dirty
