"""Fill-in-middle, SentencePiece encoding and tokenizer alignment against brute force and the libraries."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarifa.llm import align, common, fim, pieces, queries

ODD = list("ab<PSM> é漢😀Zz>\n\t\x00▁") + ["<P>", "<P", "<<S>", "word", " the", "  ", "<s>", "</s>", "<0x41>", "<|endoftext|>", "ﬁ", "Å", "�", "　"]
CLASHING = ("n_units", "form", "output", "restored", "ids", "decoded", "draw0", "run", "k", "t", "i")


def texts(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randrange(50))) for _ in range(n)]
    return [None, "", " ", "  ", "▁", "a", "<P", "<M>", *out, *out[:5], "the same words " * 3000, "x" * 70_000, "漢" * 9000]


@pytest.fixture(scope="module")
def rows():
    return [(None if k in (3, 4) else k // 2 if k > 90 else k, t) for k, t in enumerate(texts(7, 150))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.concat(F.lit(f"mine-{c}-"), F.coalesce(F.length("text").cast("string"), F.lit("none"))).alias(c) for c in CLASHING])
    return common.written(df.repartition(5), "fixture")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def ordered(rows):
    return sorted(rows, key=repr)


def own_values_left(rows):
    return all(r[c] == f"mine-{c}-{'none' if r.text is None else len(r.text)}" for r in rows for c in CLASHING)


# ---------------------------------------------------------------- fill in middle


def test_automaton_forgets_and_counts():
    a = fim.automaton()
    rng = random.Random(1)
    raw = "".join(rng.choice(ODD) for _ in range(9000)).encode()
    data = np.frombuffer(raw, np.uint8)
    state, out = 0, []
    for byte in raw:  # one byte after another, without lanes
        out.append(int(a.emitted[state * 256 + byte]))
        state = int(a.following[state * 256 + byte])
    assert a.scan(data).tolist() == out
    assert sum(x & fim.CODE for x in out) == len(raw.decode())
    assert a.scan(np.zeros(0, np.uint8)).tolist() == []
    for wrong in (("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("é", "<S>", "<M>")):
        with pytest.raises((ValueError, UnicodeEncodeError)):
            fim.Automaton(wrong)


def test_fill_in_middle_is_the_contract(spark, docs, rows, empty):
    got = fim.restore(fim.transform(docs), "output_", "form_").collect()
    names = [*(f"{n}_" if n in CLASHING else n for n in fim.RESULTS)]
    assert ordered(tuple(r[c] for c in ("doc_id", *names)) for r in got) == ordered((i, *fim.brute_force(i, t)) for i, t in rows)
    assert all(r.restored_ == (r.text or "") for r in got) and own_values_left(got)
    assert {r.form_ for r in got} == {"plain", "psm", "spm"}
    small = fim.digest(docs).filter("doc_id = 9").first()
    want = fim.brute_force(9, dict(rows)[9])
    assert (small.n, small.form, small.output_sha256) == (want[0], want[1], hashlib.sha256(want[4].encode()).hexdigest())
    assert fim.digest(empty).count() == 0


def test_fill_in_middle_sentinels_and_rates(spark, docs, rows):
    plain = fim.transform(docs, percent=0).filter("form_ <> 'plain' or output_ <> coalesce(text, '')")
    assert plain.count() == 0
    own = fim.transform(docs, percent=100, spm_percent=100, seed=5, sentinels=("[[pre", "[[suf", "[[mid"))
    back = fim.restore(own, "output_", "form_", ("[[pre", "[[suf", "[[mid"))
    assert back.filter("restored_ <> coalesce(text, '')").count() == 0 and {r.form_ for r in own.select("form_").distinct().collect()} == {"plain", "spm"}
    with pytest.raises(Exception, match="isn't an output"):
        fim.restore(spark.createDataFrame([("<P>a<M>b<S>c", "psm")], "output string, form string")).collect()


# ---------------------------------------------------------------- SentencePiece


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c▁\n漢é "), max_size=40) | st.text(max_size=20))
def test_chunks_encode_as_the_library(text):
    m = pieces.model(pieces.model_path())
    assert [i for ids in m.encode(m.chunks(text)) for i in ids] == m.sp.encode(text)


def test_sentencepiece_is_the_library(spark, docs, rows, empty):
    sp = pieces.model(pieces.model_path()).sp
    made = pieces.decode(pieces.encode(docs), ids_col="ids_").collect()
    want = [(i, t, sp.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows]
    assert ordered((r.doc_id, r.text, list(r.ids_), r.decoded_) for r in made) == ordered((i, t, ids, sp.decode(ids)) for i, t, ids in want)
    assert own_values_left(made)
    got = pieces.digest(docs).collect()
    digests = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for i, _, ids in want]
    assert ordered(map(tuple, got)) == ordered(digests)
    assert pieces.digest(empty).count() == 0


def test_each_distinct_word_is_segmented_once(monkeypatch):
    """Runs send a word once each; its bucket segments a word of many runs once."""
    m = pieces.model(pieces.model_path())
    seen = []
    encode = m.encode
    monkeypatch.setattr(m, "encode", lambda words: seen.extend(words) or encode(words))
    words = [[f"▁w{k % (500 + r)}é" for k in range(700)] for r in range(4)]
    own = [list(dict.fromkeys([*w, "▁the", "▁▁"])) for w in words]
    sent = pa.Table.from_batches([pieces.sent_words(f"r{r}", w, 7) for r, w in enumerate(own)])
    assert sent.num_rows == 28
    back = [pieces._answered(m, sent.take(np.flatnonzero(np.asarray(sent["bucket"]) == b))) for b in range(7)]
    assert len(seen) == len(set(seen)) == len({w for x in own for w in x})
    replies = pa.concat_tables(back)
    for r, w in enumerate(own):
        flat, off = pieces._replies(replies.take(np.flatnonzero(np.asarray(replies["run"]) == f"r{r}")), len(w))
        assert [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == encode(w)


def test_a_second_pass_over_other_rows_fails(spark):
    def other(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([os.urandom(8).hex() for _ in range(batch.num_rows)])], names=["doc_id", "text"])

    df = spark.range(400).mapInArrow(other, "doc_id long, text string")
    with pytest.raises(Exception, match="other rows in the second pass"):
        pieces.encode(df).collect()


def test_a_vocabulary_whose_pieces_cross_marks_keeps_texts_whole(monkeypatch):
    m = pieces.Model(pieces.model_path())
    m.find = lambda text: [text]
    for t in ("a b", " ", "a  b ", "漢 字"):
        assert [i for ids in m.encode(m.chunks(t)) for i in ids] == m.sp.encode(t)


# ---------------------------------------------------------------- alignment


def test_byte_tokens_are_those_of_the_json_file():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(align.path_a())
    library.encode_special_tokens = True
    some = [t for t in texts(11, 400) if t]
    want = [e.ids for e in library.encode_batch([" " + t for t in some], add_special_tokens=False)]
    assert [x.tolist() for x in align.ByteTokens(align.path_a()).ids(some)] == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40)))
def test_relations_of_intervals(x, y):
    a, b = np.array(sorted(x | {41})), np.array(sorted(y | {41}))
    al = align.align(a, b)
    span = lambda ends, k: (ends[k - 1] if k else 0, ends[k])
    every = [(i, j) for i in range(len(a)) for j in range(len(b))]
    over = {(i, j) for i, j in every if max(span(a, i)[0], span(b, j)[0]) < min(span(a, i)[1], span(b, j)[1])}
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    group = lambda e: sum(s < e for s in shared)
    pairs = lambda r: list(zip(*(v.tolist() for v in al.links(r))))
    assert set(pairs("overlap")) == over and len(pairs("overlap")) == len(over)
    assert pairs("end") == [(i, j) for i, j in every if a[i] == b[j]]
    assert sorted(pairs("group")) == [(i, j) for i, j in every if group(a[i]) == group(b[j])]


def test_alignment_is_the_contract(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    library, sp = Tokenizer.from_file(align.path_a()), pieces.model(pieces.model_path()).sp
    library.encode_special_tokens = True
    of = align.byte_alphabet()
    short = [(i, t if t is None or len(t) < 5_000 else t[:1500]) for i, t in rows]
    table = common.written(spark.createDataFrame(short, "doc_id long, text string").repartition(4), "fixture")
    want = align.brute_force(short, lambda t: library.encode(t, add_special_tokens=False).ids, sp.encode, lambda k: bytes(of[c] for c in library.id_to_token(k)), lambda k: bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode())
    got = align.digest(table).collect()
    assert ordered(tuple(r)[:8] for r in got) == ordered(want)
    assert any(w[3] for w in want) and any(w[1] == 0 and t and "▁" in t for w, (_, t) in zip(want, short))
    assert all(r.n_groups <= r.n_overlaps <= r.n_products for r in got)
    whole = align.alignment(docs.filter("length(text) < 200"), relation="group").collect()
    assert all(r.n_links == r.n_products for r in whole) and align.digest(empty).count() == 0
    with pytest.raises(ValueError):
        align.alignment(docs, relation="none")


def test_queries_are_registered():
    assert {"op11_fill_in_middle", "op12_sentencepiece", "op13_tokenizer_alignment"} <= set(queries.queries())


def test_words_of_ascii_need_no_normaliser():
    """Ids joined word by word are those of whole texts, for marks, cases, white space and spelled-out special tokens."""
    from tarifa.llm import packing

    texts = ["Don't DON'T it''s 'tthe", "a\x0bB \x0c x\x1cY", "<|endoftext|>x a<|STARTOFTEXT|>b <|startoftext|>", "É é 中文12a_-_ \x01 b\x01", "", "Word, word. WORD"]
    encoder = packing.WordEncoder(packing.tokenizer_path())
    ids, off = encoder.encode(texts)
    assert encoder.lowers and encoder.tokenizer.normalizer is not None
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[off[k] : off[k + 1]].tolist() for k in range(len(texts))] == want


def test_a_run_is_encoded_once_for_all_words_that_have_it():
    """Case and punctuation make other words of the same runs; ids are those of whole texts, and other scripts go whole."""
    from tarifa.llm import packing

    encoder, asked = packing.WordEncoder(packing.tokenizer_path()), []
    ids_of = encoder._ids
    encoder._ids = lambda texts: asked.extend(texts) or ids_of(texts)
    texts = ["Straße, straße. STRAßE (Straße)", "(l'été) L'ÉTÉ, 12 1.2", "x\xa0y ſ İ 水,水"]
    ids, off = encoder.encode(texts)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[off[k] : off[k + 1]].tolist() for k in range(len(texts))] == want
    told = " ".join(asked).split(" ")
    assert [told.count(w) for w in ("straße", "Straße", "été", ",", "1", "2")] == [1, 0, 1, 1, 1, 1]
