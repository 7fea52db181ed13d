"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more.

1. Byte-identical texts are collapsed to the smallest doc_id; only that one is compared. The texts are not
   shuffled for this: a run of a task reads each text once, and copies that are left from other runs go by
   their id, when the shingles of a document meet.
2. Shingles are dealt to tasks by value, in sorted delta-coded blocks. A task sees every holder of a shingle,
   so document frequencies are exact; a shingle of one document can match nothing and leaves the data here,
   though it still counts among the rarest places of its document's order. What is left goes to the tasks
   of the documents, one packed row for each task and group of documents. The join needs only one order of shingles
   for all documents, so the few that a sample of documents finds very frequent are put last in it and go to
   their documents at once: no task gathers the holders of a shingle of a third of all documents.
3. Shingles are ordered by (frequency, number). With a = ceil(0.75 n), a document that links must share
   l of the first n - a + l shingles with its partner. Each document lengthens its prefix to the l with the
   least estimated cost (postings to read, and candidates to verify, which fall with l); a pair is
   verified only if it shares min(l, l') prefix shingles.
4. Candidates come from the postings of prefix shingles in two passes. The first compares the holders of a
   shingle with its least and its greatest holder only, which finds most classes at a cost in proportion to
   the postings. The second takes what is left: shingles whose holders are in several classes, and only pairs
   of different classes, as no other link can change a class. Shingles of few holders count the matches
   of each pair by a join; holders of others are cut into blocks of bounded size, and every two blocks count
   their matches as a product of presence matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quillon.llm.blocks import bucket_of, bundle, components, deltas, mixed, partitions, pieces, salted_join, sliced, summed, trimmed, unbundle
from quillon.session import discard, saved

WORDS, PERCENT, BLOCK, LONGEST, FEW, GROUP = 5, 75, 256, 16, 16, 512
SAMPLE_DOCS, SAMPLE_SHARE, MOST_HOT = 4096, 64, 65536
HOT = 1 << 60
TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
BLOBS, NAMES = "bucket int, source int, blob binary", ["bucket", "source", "blob"]
THROUGH = -1  # source of what needs no other task on its way to the documents


def shingles(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (index of the text, hash), sorted."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    turns = np.array([TURN[j % len(TURN)] * np.uint64(2 * (j // len(TURN)) + 1) for j in range(width)], np.uint64)
    many = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(words)), many)
    at = np.arange(int(many.sum())) + np.repeat(starts - (np.cumsum(many) - many), many)
    value = np.zeros(len(at), np.uint64)
    for j in range(width):
        value += flat[at + j] * turns[j]
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    short = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[i]), 5) for i in few), np.uint64, len(few))
    doc, value = np.r_[doc, few], mixed(np.r_[value, short])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        keep = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]
        doc, value = doc[keep], value[keep]
    return doc, value


def sampled(width: int):
    """Shingles of a partition with the number of its documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text", "doc_id", 2 << 20):
            value, n = np.unique(shingles(texts, width)[1], return_counts=True)
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])

    return run


def frequent(docs: DataFrame, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Very frequent shingles by a sample of documents, sorted, and their expected frequencies.

    Which ones they are changes no result, only where they stand in the order of all shingles. At most MOST_HOT.
    """
    rate = max(1, total // SAMPLE_DOCS)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rate)) == 0)
    least = max(16, total // rate // SAMPLE_SHARE)
    top = some.mapInArrow(sampled(width), "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(MOST_HOT).toArrow()
    value, n = top["value"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(value)
    return value[order], n[order] * rate


def dealt(parts: int, width: int, hot, most: int = 1_500_000):
    """Blocks of shingles for each of `parts` tasks; set sizes and very frequent shingles to one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value[0]
        values, owners, held = [], [], 0
        place: dict[bytes, int] = {}  # of each text of the run
        least: list[int] = []  # the smallest id of each
        sizes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.array(least, np.int64)
            value, owner = np.concatenate(values), np.concatenate(owners)
            at = np.searchsorted(known, value)
            at[at == len(known)] = 0
            often = known[at] == value if len(known) else np.zeros(len(value), bool)
            blob = bundle(ids, np.concatenate(sizes), owner[often], at[often])
            yield pa.record_batch([pa.array([int(ids[0]) % parts], pa.int32()), pa.array([THROUGH], pa.int32()), pa.array([blob], pa.binary())], NAMES)
            order = np.argsort(value, kind="stable")  # owners are in order
            order = order[~often[order]]
            value, owner = value[order], owner[order]
            bucket = ((value >> np.uint64(49)) * np.uint64(parts) >> np.uint64(15)).astype(np.int64)
            out = []
            for b, s in sliced(bucket):
                table, own = np.unique(owner[s], return_inverse=True)
                out.append((b, bundle(*deltas(value[s]), ids[table], own)))
                if len(out) == 64:
                    yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()), pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], NAMES)
                    out.clear()
            if out:
                yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()), pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], NAMES)

        for keys, texts in pieces(batches, "text", "doc_id", 1 << 20):
            fresh, start = [], len(least)
            for k, t in zip(keys, texts):
                i = place.setdefault(xxhash.xxh3_128_digest(t), len(least))
                if i == len(least):
                    least.append(k)
                    fresh.append(t)
                else:
                    least[i] = min(least[i], k)
            doc, value = shingles(fresh, width)
            values.append(value)
            owners.append((doc + start).astype(np.int32))
            sizes.append(np.bincount(doc, minlength=len(fresh)))
            held += len(doc) + 8 * len(fresh)
            if held >= most:
                yield from flush()
                values, owners, held = [], [], 0
                place.clear(), least.clear(), sizes.clear()
        if held:
            yield from flush()

    return run


def shared(groups: int):
    """From all blocks of a task: for each group of documents one row of their sizes, shared shingles and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, through, bucket = [], [], 0
        for batch in batches:
            for b, source, blob in zip(*(batch.column(c).to_pylist() for c in NAMES)):
                found = unbundle(blob)
                if source == THROUGH:
                    ids, n, owner, at = found
                    through.append((ids, n, ids[owner], at))
                    continue
                bucket = b
                *value, table, own = found
                blocks.append((summed(value), table[own]))
        none = np.zeros(0, np.int64)
        ids, n, hot_doc, hot_at = (np.concatenate(x) for x in zip(*through)) if through else (none,) * 4
        doc, place, df = none, none, none
        if blocks:
            value, doc = (np.concatenate(x) for x in zip(*blocks))
            blocks.clear()
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            del order
            once = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]  # a repeated row counts once
            value, doc = value[once], doc[once]
            first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            df = np.diff(np.r_[first, len(value)])
            many = df > 1
            place = np.repeat(np.cumsum(many) - 1, df)  # numbers the shingles with several holders
            keep = np.repeat(many, df)
            df = np.repeat(df, df)[keep]
            doc, place = doc[keep], place[keep]
        columns = []
        for k, *rest in ((doc, place, df), (ids, n), (hot_doc, hot_at)):
            at = bucket_of(k, groups)
            order = np.lexsort((*rest[:1], k, at))
            columns.append(({b: s for b, s in sliced(at[order])}, k[order], *(r[order] for r in rest)))
        (a, doc, place, df), (b, ids, n), (c, hot_doc, hot_at) = columns
        nothing = slice(0, 0)
        out = []
        for to in sorted(a.keys() | b.keys() | c.keys()):
            x, y, z = a.get(to, nothing), b.get(to, nothing), c.get(to, nothing)
            own, count = np.unique(doc[x], return_counts=True)
            out.append((to, bucket, bundle(own, count, place[x], df[x], ids[y], n[y], hot_doc[z], hot_at[z])))
            if len(out) == 64:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], NAMES)
                out.clear()
        if out:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], NAMES)

    return run


def copies_dealt(groups: int):
    """Ids to leave out, for the groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            at = bucket_of(ids, groups)
            order = np.argsort(at, kind="stable")
            rows = [(b, bundle(ids[order][s])) for b, s in sliced(at[order])]
            if rows:
                yield pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), pa.array([THROUGH] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], NAMES)

    return run


def prefix(n: int, dfs: np.ndarray, percent: int, longest: int) -> tuple[int, int]:
    """(l, number of shared shingles in the prefix) for a document of n shingles, of which those in dfs (in order) have other holders.

    The cost of l: the postings behind the prefix plus the candidates left, taken as those postings over l.
    """
    need = -(-percent * n // 100)
    alone = n - len(dfs)
    ends = np.clip(n - need + np.arange(1, min(longest, need) + 1) - alone, 0, len(dfs))
    if not ends[0]:
        return 1, 0
    reach = np.r_[0, np.cumsum(dfs - 1)][ends]
    level = np.arange(1, len(ends) + 1)
    best = int(np.argmin(reach + 8.0 * reach / level))
    return best + 1, int(ends[best])


PROFILE = "doc_id long, n long, tokens array<long>, level int, size int"


def profiled(percent: int, longest: int, hot):
    """Each document of a group: its size, and if it can link its shared shingles in order and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = hot.value[1]
        rank = np.argsort(np.argsort(expected, kind="stable"))
        docs, tokens, dfs, sizes, gone = [], [], [], [], []
        for batch in batches:
            for source, blob in zip(*(batch.column(c).to_pylist() for c in NAMES[1:])):
                found = unbundle(blob)
                if source == THROUGH:
                    gone.append(found[0])
                    continue
                own, count, place, df, ids, n, hot_doc, hot_at = found
                docs += [np.repeat(own, count), hot_doc]
                tokens += [place + (source << 40), rank[hot_at] + HOT]
                dfs += [df, expected[hot_at]]
                sizes.append((ids, n))
        if not sizes:
            return
        ids, n = (np.concatenate(x) for x in zip(*sizes))
        ids, first = np.unique(ids, return_index=True)  # several runs may hold a repeated row
        n = n[first]
        here = ~np.isin(ids, np.concatenate(gone)) if gone else np.ones(len(ids), bool)
        doc, token, df = np.concatenate(docs), np.concatenate(tokens), np.concatenate(dfs)
        del docs, tokens, dfs
        order = np.lexsort((token, df, token >= HOT, doc))
        doc, token, df = doc[order], token[order], df[order]
        if len(doc):
            once = np.r_[True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])]
            doc, token, df = doc[once], token[once], df[once]
        starts, ends = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
        names = [f.split()[0] for f in PROFILE.split(", ")]
        for i in range(0, len(ids), 5000):
            some = [k for k in range(i, min(len(ids), i + 5000)) if here[k]]
            chosen = [prefix(int(n[k]), df[starts[k] : ends[k]], percent, longest) if ends[k] > starts[k] else (1, 0) for k in some]
            lists = [token[starts[k] : ends[k]] if size else None for k, (_, size) in zip(some, chosen)]
            yield pa.record_batch([pa.array(ids[some]), pa.array(n[some]), pa.array(lists, pa.list_(pa.int64())), pa.array([x for x, _ in chosen], pa.int32()), pa.array([x for _, x in chosen], pa.int32())], names)

    return run


def linked(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), a the one with many partners, those that share enough of their prefixes and link."""
    x = ordered.select(*(F.col(c).alias(f"x_{c}") for c in ordered.columns))
    y = ordered.select(*(F.col(c).alias(f"y_{c}") for c in ordered.columns))
    met = pairs.join(x, F.col("b") == F.col("x_doc_id")).join(y, F.col("a") == F.col("y_doc_id"))
    fronts = F.size(F.array_intersect(F.slice("x_tokens", 1, F.col("x_size")), F.slice("y_tokens", 1, F.col("y_size"))))
    both = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return met.filter(fronts >= F.least("x_level", "y_level")).filter(100 * both >= percent * (F.col("x_n") + F.col("y_n") - both)).select("a", "b")


def verified(percent: int, every: bool):
    """Links inside a block or between two, of documents of different classes: all of them, or enough to join what they join."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        ids, n, level, size, block, label = (t[c].to_numpy() for c in ("doc_id", "n", "level", "size", "block", "label"))
        tokens = t["tokens"].combine_chunks()
        lengths = np.diff(tokens.offsets.to_numpy())
        names, flat = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(ids)), lengths)
        front = np.arange(len(flat)) - starts[doc] < size[doc]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        place = np.zeros(len(ids), np.int64)
        counts = np.zeros((len(left), len(right)), np.float32)
        here = [np.isin(doc, side) & front for side in (left, right)]
        common = np.flatnonzero(np.logical_and(*(np.bincount(flat[h], minlength=len(names)) > 0 for h in here)))
        for i in range(0, len(common), 2048):
            sides = []
            for side, h in zip((left, right), here):
                place[side] = np.arange(len(side))
                at = np.searchsorted(common[i : i + 2048], flat[h])
                at[at == len(common[i : i + 2048])] = 0
                good = common[i : i + 2048][at] == flat[h]
                m = np.zeros((len(side), min(2048, len(common) - i)), np.float32)
                m[place[doc[h][good]], at[good]] = 1
                sides.append(m)
            counts += sides[0] @ sides[1].T
        fit = (counts >= np.minimum.outer(level[left], level[right])) & (label[left][:, None] != label[right][None, :])
        if lo == hi:
            fit &= np.triu(np.ones_like(fit), 1)
        _, group = np.unique(label, return_inverse=True)
        parent = np.arange(len(group))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        mark, found = np.zeros(len(names), bool), []
        for i in np.flatnonzero(fit.any(1)):
            x = left[i]
            mine = flat[starts[x] : starts[x] + lengths[x]]
            mark[mine] = True
            for y in right[fit[i]]:
                a, b = root(group[x]), root(group[y])
                if a != b or every:
                    both = int(mark[flat[starts[y] : starts[y] + lengths[y]]].sum())
                    if 100 * both >= percent * (n[x] + n[y] - both):
                        found.append((ids[x], ids[y]))
                        parent[a] = b
            mark[mine] = False
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def residual_links(ordered: DataFrame, label: DataFrame, percent: int, block: int, few: int, every: bool = False) -> DataFrame | None:
    """Links (a, b) between documents of different classes of label(id, component); a document that it lacks is its own class."""
    own = ordered.join(label, ordered.doc_id == label.id, "left").select("doc_id", "n", "tokens", "level", "size", F.coalesce("component", "doc_id").alias("label"))
    posts = own.select("doc_id", "level", "label", F.explode(F.slice("tokens", 1, F.col("size"))).alias("token"))
    several = posts.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("holders"), F.min("doc_id").alias("leader")).filter("low <> high")
    rest = saved(posts.join(several.select("token", "holders", "leader"), "token"), "residual")
    if rest.isEmpty():
        return None
    small = rest.filter(F.col("holders") <= few)
    one, two = (small.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "level", "label"))) for k in "ab")
    pairs = (
        one.join(two, "token").filter("doc_id_a < doc_id_b and label_a <> label_b")
        .groupBy(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("level_a", "level_b")).alias("level"))
        .filter("c >= level").select("a", "b")
    )
    found = linked(saved(pairs, "pairs"), ordered, percent)
    big = rest.filter(F.col("holders") > few)
    family = components(big.filter("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct())
    sizes = family.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    family = saved(family, "families")
    if not family.isEmpty():
        places = salted_join(family.withColumnRenamed("id", "doc_id"), sizes, ["component"], "doc_id")
        placed = (
            own.join(places, "doc_id")
            .withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        )
        found = found.union(placed.groupBy("component", "lo", "hi").applyInArrow(verified(percent, every), "a long, b long"))
    return found.distinct()


def profiles(docs: DataFrame, members: DataFrame, percent: int, width: int, longest: int) -> DataFrame:
    """Stored table of every distinct text by its least id: doc_id, n, tokens, level, size."""
    spark = docs.sparkSession
    total, parts = docs.count(), min(2 * partitions(spark), 32768)  # shingles take more room in a task than texts
    groups = max(1, min(parts, total // GROUP))
    hot = spark.sparkContext.broadcast(frequent(docs, total, width))
    blocks = docs.mapInArrow(trimmed(dealt(parts, width, hot)), BLOBS).repartitionById(parts, "bucket")
    copied = members.filter("doc_id <> rep").select("doc_id").mapInArrow(copies_dealt(groups), BLOBS)
    met = blocks.mapInArrow(trimmed(shared(groups)), BLOBS).union(copied).repartitionById(groups, "bucket")
    return saved(met.mapInArrow(trimmed(profiled(percent, longest, hot)), PROFILE), "profiles")


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) without null ids, one text for an id; and stored members(doc_id, rep), rep the least id with the same text."""
    docs = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    keyed = saved(docs.groupBy("doc_id").agg(F.min(digest).alias("digest"), F.max(digest).alias("high")), "digests")
    if not keyed.filter("digest <> high").isEmpty():  # an id with several texts: only the one with the least digest counts
        docs = docs.join(keyed.select("doc_id", "digest"), "doc_id").filter(digest == F.col("digest")).select("doc_id", "text")
    keyed = keyed.drop("high")
    groups = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    members = saved(salted_join(keyed, groups, ["digest"], "doc_id").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "members")
    return docs, members


def unnamed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(batches, "text", "doc_id", 2 << 20):
            n = np.bincount(shingles(texts, width)[0], minlength=len(texts))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n), pa.nulls(len(keys), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return run


def jaccard_pairs(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, block: int = BLOCK, longest: int = LONGEST, few: int = FEW) -> DataFrame:
    """All links between different texts of docs(doc_id, text, ...): (a, b), a < b, each text by its least doc_id.

    Together with which ids share a text this is every link. A class of g texts may have g * g / 2 of them. Rows and
    ids are treated as in jaccard_links.
    """
    docs, members = distinct_texts(docs)
    ordered = saved(profiles(docs, members, percent, width, longest).filter("size > 0"), "prefixes")
    none = members.selectExpr("doc_id as id", "rep as component").limit(0)
    found = residual_links(ordered, none, percent, block, few, every=True)
    return none.selectExpr("id as a", "component as b") if found is None else found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_links(docs: DataFrame, percent: int = PERCENT, width: int = WORDS, block: int = BLOCK, longest: int = LONGEST, few: int = FEW) -> DataFrame:
    """Near-duplicate classes of docs(doc_id, text, ...): doc_id, n_shingles, component_id.

    Null or empty text, and text of white space only, has an empty set and links with nothing. Rows with a null
    doc_id keep their rows with a null component_id: no id names them, and they link with nothing. Rows that
    repeat a doc_id count once (of several texts, the one with the least MD5). Other columns are ignored.
    """
    whole = docs
    docs, members = distinct_texts(docs)
    profile = profiles(docs, members, percent, width, longest)
    ordered = saved(profile.filter("size > 0"), "prefixes")
    posts = ordered.select("doc_id", F.explode(F.slice("tokens", 1, F.col("size"))).alias("token"))
    ends = posts.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    near = posts.join(ends, "token").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("doc_id").alias("b")), F.struct(F.col("high").alias("a"), F.when(F.col("doc_id") != F.col("low"), F.col("doc_id")).alias("b")))).alias("p"))
    near = saved(near.select("p.a", "p.b").filter("a <> b").distinct(), "near")
    label = saved(components(linked(near, ordered, percent)), "classes")
    more = residual_links(ordered, label, percent, block, few)
    if more is not None:
        of = lambda c: (label.select(F.col("id").alias(c), F.col("component").alias(f"{c}_class")))
        both = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
        over = saved(components(both.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))), "classes")
        over = over.select(F.col("id").alias("class"), F.col("component").alias("top"))
        every = label.union(over.selectExpr("class as id", "class as component").join(label.select("id"), "id", "left_anti"))
        label = saved(every.join(over, every.component == over["class"], "left").select("id", F.coalesce("top", "component").alias("component")), "classes")
    sizes = saved(profile.join(label, profile.doc_id == label.id, "left").select(F.col("doc_id").alias("rep"), "n", F.coalesce("component", "doc_id").alias("class")), "sizes")
    discard(near)
    single = members.filter("doc_id = rep").join(sizes, "rep", "left")
    named = single.unionByName(salted_join(members.filter("doc_id <> rep"), sizes, ["rep"], "doc_id")).select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.when(F.coalesce("n", F.lit(0)) == 0, F.col("doc_id")).otherwise(F.coalesce("class", "rep")).alias("component_id"),
    )
    return named.union(whole.filter("doc_id is null").select("doc_id", "text").mapInArrow(unnamed(width), "doc_id long, n_shingles long, component_id long"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: doc_id, n_shingles, component_id. Edge cases as in jaccard_links."""
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
