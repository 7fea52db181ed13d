"""Token counts against the tokenizer, and media columns against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from quillon.llm import media, viterbi

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997} alpha{i % 13}" for i in range(6000))
TEXTS = ["", None, "   \n\t ", "one two three", "One TWO three", LONG, LONG + " more", "a" * 350, "7 8 9 !!", "été à la plage\0\0", "x" * 64, "x\0", "x", "\U0001f600 end", LONG * 12]
SCHEMA = "doc_id long, text string, digest string, parts int, media string, n_bytes string, html string"


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "d", 1, "m", "n", "h") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", None, None, None, None, None), (None, "no id", None, None, None, None, None)], SCHEMA).repartition(4)


def tokenizer(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + vocabulary, unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.SPACE, prepend_scheme="always", split=True)
    return lambda t: len(made.encode(t, add_special_tokens=False).ids) if t else 0


def test_counts_against_the_tokenizer(spark, awkward):
    vocabulary = viterbi.vocabulary()
    want = tokenizer(vocabulary)
    for df in (spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), awkward.select("doc_id", "text")):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in viterbi.token_counts(df, vocabulary).collect())
        assert got == sorted((r.doc_id if r.doc_id is not None else -1, want(r.text)) for r in df.collect())
    assert viterbi.token_counts(awkward.limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_ties(spark, seed):
    """Vocabularies in which nearly every text has several best paths of different lengths."""
    rng = random.Random(seed)
    made = {"".join(rng.choice("ab" + viterbi.SPACE) for _ in range(rng.randrange(1, 6))) for _ in range(40)} | {"a", "b", viterbi.SPACE}
    vocabulary = [(p, -1.0 * rng.randrange(1, 4) * (len(p) if seed % 2 else 1)) for p in sorted(made)]
    want, count = tokenizer(vocabulary), viterbi.counter(vocabulary)
    texts = ["".join(rng.choice("abab c") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    got = {r.doc_id: r.n_tokens for r in viterbi.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}
    assert all(sum(count(viterbi.SPACE + w) for w in viterbi.words_of(t)) == want(t) for t in texts)


def test_scores_and_path_are_parameters():
    flat = viterbi.vocabulary(viterbi.VOCABULARY, lambda n: [-1.0] * n)
    assert len(flat) > 30_000 and {s for _, s in flat} == {-1.0}
    want, count = tokenizer(flat), viterbi.counter(flat)
    for t in ("several best paths for the same words", "unbelievably internationalization", "été"):
        assert sum(count(viterbi.SPACE + w) for w in viterbi.words_of(t)) == want(t)


def plain(text):
    raw = (text or "").encode()
    data = media.payload(raw)
    assert len(data) % 64 == 0 and data and data.startswith(raw) and not data[len(raw) :].strip(b"\0")
    wav = media.stored(data)
    assert media.loaded(wav) == data
    return (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), media.feature(data))


def test_media_query(awkward, spark, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), *r[1:]) for r in media.op9_media(spark, str(tmp_path)).collect())
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, *plain(r.text)) for r in awkward.collect())
    awkward.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert media.op9_media(spark, str(tmp_path / "none")).count() == 0


def test_text_sequences_hold_their_places(awkward):
    rows = media.text_sequences(awkward).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert [(p.pos, p.kind) for p in r.parts] == [(0, "text"), (1, "audio"), (2, "text")]
        assert r.parts[1].caption in r.parts[2].text and r.parts[1].media.payload_sha256 == r.parts[1].ref[7:] and r.parts[0].media is None


def test_sequences_stay_aligned(spark):
    html = "<p>a<b>b</b></p><figure><img src='sha256:1' alt='x'><figcaption>cap one</figcaption></figure>mid<script>no</script><img src='sha256:2'><p>end"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (1, "<img src='sha256:2'>"), (None, "<p>x")], "page_id long, html string")
    store = spark.createDataFrame([("2", 5)], "digest string, size int")
    got = {}
    for r in media.resolved(media.sequences(pages), store).collect():
        got.setdefault(r.page_id, []).append([(p.kind, p.text, p.ref, p.caption, p.media and p.media.size) for p in r.parts])
    assert sorted(got[1], key=len) == [[("image", None, "sha256:2", None, 5)], [
        ("text", "ab", None, None, None), ("image", None, "sha256:1", "cap one", None), ("text", "mid", None, None, None), ("image", None, "sha256:2", None, 5), ("text", "end", None, None, None),
    ]]
    assert got[2] == got[3] == [[]] and got[None] == [[("text", "x", None, None, None)]]


def test_real_pages_with_media_between_their_parts(spark):
    """Every page of the table with three references put into it, two of them in the store."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html")
    digest = lambda k: hashlib.sha256(f"m{k}".encode()).hexdigest()
    with_media = pages.withColumn("html", F.concat(F.lit(f"<img src='sha256:{digest(0)}' alt='first'>"), F.regexp_replace("html", "</p>", f"</p><img src='sha256:{digest(1)}'>"), F.lit(f"<figure><img src='sha256:{digest(2)}'><figcaption>last</figcaption></figure>")))
    store = spark.createDataFrame([(digest(0), 0), (digest(1), 1)], "digest string, number int")
    plain_parts = {r.page_id: [p.text for p in r.parts if p.kind == "text"] for r in media.sequences(pages).collect()}
    rows = media.resolved(media.sequences(with_media), store).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert [p.pos for p in r.parts] == list(range(len(r.parts)))
        assert [p.text for p in r.parts if p.kind == "text"] == plain_parts[r.page_id]
        refs = [(p.ref[7:], p.caption, p.media and p.media.number) for p in r.parts if p.ref and p.ref.startswith("sha256:")]
        assert refs[0] == (digest(0), "first", 0) and refs[-1] == (digest(2), "last", None) and all(x == (digest(1), None, 1) for x in refs[1:-1])
