"""N-gram Jaccard join with grouped prefixes; classes of near-duplicate documents.

A document's set holds its distinct five-word shingles (64-bit hashes). The steps:

1. Equal sets (128-bit sum of mixed hashes, and size) are one class with its smallest
   id; only that one goes on.
2. Every document sends the shingles below a fixed share of the hash range, and the
   first fifth of its set in hash order: by bucket they tell which shingles no other
   document has. A document that has more than a fifth of its set to itself cannot
   link; it stops here. The documents left do the same once more among themselves, with
   their whole sets. The prefix is taken after the shingles of one's own.
3. Documents with the same prefix and size are one group; groups meet by prefix
   shingle and sizes at most a fifth apart. First each group member is paired with
   its leader, and each group with its nearest neighbours in every bucket. These
   pairs are verified on the texts, and components built.
4. Documents with the same prefix, size and component are now one group. Group pairs of
   a bucket that can link and are in two components stay open. Where they are few they
   are expanded to their members and verified. Where a bucket has more of them than
   ``PAIRS_EACH`` a document, its groups form a cluster instead: every member's set is sent
   once for each block of the cluster, two blocks are compared as a whole in one task,
   and only the links that join components come out. So no link between different
   components is left out, and no table of all pairs of a large group is ever written.

Entries are packed and combined by batch before every shuffle: a set or shingle that a
third of all documents share is sent once a batch.

Defined cases: a null or empty text has an empty set and links with nothing; fewer than
five words are one shingle; very long texts are taken whole; every row is a document: rows
that repeat an id and a text get the same result, rows that repeat an id with another text
are documents of their own (all rows are then keyed by a number for id and text); a null id is left
out of all links and is returned with a null component; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import wordhash as wh
from tallyloom.llm.components import components
from tallyloom.llm.store import materialize

SHINGLE = 5
#: similarity in hundredths
SIMILAR = 80
#: share of the hash range whose shingles all documents send
EXAMINED = 0.3
MARK = ["<u8", "<i8", "<i4"]  # shingle, document, home bucket of the document
#: shingle, group, size, first shingle, component, most that can be shared from here on, members
GROUP = ["<u8", "<i8", "<i8", "<u8", "<i8", "<i8", "<i8"]
PAIRS = "a long, b long"
#: home of an entry that stands for all documents of a shingle that a task has combined
NO_HOME = -1
#: entries that a task combines before it sends them: bounds its memory
COMBINED = 1 << 20
#: open pairs for each document of a bucket that are sent as pairs; beyond, documents are sent
PAIRS_EACH = 16
#: a block of a hot cluster holds at most so many documents and about so many bytes of sets
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: a hot cluster is spread over at least so many blocks, unless these hold fewer documents
SPREAD, SPREAD_LEAST = 12, 256


def shingle_sets(raw: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of distinct shingles, sorted by text and hash."""
    words, ends = wh.hash_words(raw, fold=True)
    text, place = wh.places(ends)
    n = np.diff(ends, prepend=0)
    h = wh.windows(words, k)
    at = np.flatnonzero(place[: len(h)] + k <= n[text[: len(h)]])
    t, s = text[at], h[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = [wh.windows(words[ends[i] - n[i] : ends[i]], int(n[i]), int(n[i]))[0] for i in short]
        t, s = np.concatenate((t, short)), np.concatenate((s, np.array(whole, np.uint64)))
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    first, _ = wh.groups(t, s)
    return t[first], s[first]


def _prefix_size(n: np.ndarray, similar: int) -> np.ndarray:
    """n - ceil(similar * n) + 1"""
    return n - -(-n * similar // 100) + 1


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles and a 128-bit fingerprint of the set.

    Null ids travel as a mark beside a zero: a null among them would turn ids into floats."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some, raw in wh.chunks(pdf, "text"):
                t, s = shingle_sets(raw)
                n = np.bincount(t, minlength=len(some))
                one, two = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
                np.add.at(one, t, wh.mix(s))
                np.add.at(two, t, wh.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                yield some[["doc_id", "nameless", "hash"]].assign(n=n, f1=one.view(np.int64), f2=two.view(np.int64))

    marked = docs.withColumns({"nameless": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    sizes = marked.mapInPandas(measure, "doc_id long, nameless boolean, hash long, n long, f1 long, f2 long")
    return sizes.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def _edge(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2.0**64), 2**64 - 1))


def _marks(buckets: int, similar: int, share: float):
    edge = _edge(share)

    def combined(got: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
        s, d, b = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((d, s))
        s, d, b = s[order], d[order], b[order]
        first, ends = wh.groups(s)
        shared = d[first] != d[ends - 1]
        known = np.repeat(shared, ends - first)
        yield wh.packed(b[known].astype(np.int64), [s[known], d[known], b[known]], 1)
        go = np.concatenate((np.flatnonzero(~known), first[shared]))
        sent = [s[go], d[go], np.where(known[go], NO_HOME, b[go]).astype(np.int32)]
        yield wh.packed((sent[0] % np.uint64(buckets)).astype(np.int64), sent)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, held = [], 0
            for some, raw in wh.chunks(pdf, "text"):
                t, s = shingle_sets(raw)
                n = np.bincount(t, minlength=len(some))
                rank = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
                at = np.flatnonzero((s < edge) | (rank < _prefix_size(n, similar)[t]))
                ids, home = some["doc_id"].to_numpy(np.int64), some["bucket"].to_numpy(np.int32)
                got.append([s[at], ids[t[at]], home[t[at]]])
                held += len(at)
                if held >= COMBINED:
                    yield from combined(got)
                    got, held = [], 0
            if got:
                yield from combined(got)

    return find


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles in two documents, packed by the home of their document."""

    def found() -> Iterator[list[np.ndarray]]:
        for pdf in wh.by_bucket(batches):
            s, d, b = wh.unpacked(pdf.loc[pdf["kind"] == 1, "load"].tolist(), MARK)
            yield [b, s, d, b]
            s, d, b = wh.unpacked(pdf.loc[pdf["kind"] == 0, "load"].tolist(), MARK)
            order = np.lexsort((d, s))
            s, d, b = s[order], d[order], b[order]
            first, ends = wh.groups(s)
            two = d[first] != d[ends - 1]
            if len(s):
                two |= np.logical_or.reduceat(b == NO_HOME, first)
            keep = np.repeat(two, ends - first) & (b != NO_HOME)
            yield [b[keep], s[keep], d[keep], b[keep]]

    yield from wh.repacked(found(), 1)


def _candidates(similar: int, share: float):
    """Texts and shared shingles of one home bucket -> documents that can link, with prefixes.

    ``lefts``: by prefix shingle, how much of the set is neither the document's own nor
    before that shingle; a pair that meets there first shares no more than the smaller.
    """
    edge = _edge(share)

    def find(texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        s, d, _ = wh.unpacked(marks.loc[marks["kind"] == 1, "load"].tolist(), MARK)
        copies = set(wh.unpacked(marks.loc[marks["kind"] == 3, "load"].tolist(), ["<i8"])[0].tolist())
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        first, ends = wh.groups(d)
        known = {int(d[a]): s[a:z] for a, z in zip(first, ends, strict=True) if int(d[a]) not in copies}
        wanted = texts[texts["doc_id"].isin(list(known))].drop_duplicates("doc_id")
        rows = []
        for some, raw in wh.chunks(wanted, "text") if len(wanted) else ():
            t, sh = shingle_sets(raw)
            n = np.bincount(t, minlength=len(some))
            ends_t = np.cumsum(n)
            for i, (doc, x) in enumerate(zip(some["doc_id"].tolist(), some["text"], strict=True)):
                mine, hits = sh[ends_t[i] - n[i] : ends_t[i]], known[doc]
                met = np.isin(mine, hits, assume_unique=True)
                own = (mine < edge) & ~met
                p = int(_prefix_size(n[i : i + 1], similar)[0]) - int(own.sum())
                if p <= 0:
                    continue
                rest = np.flatnonzero(~own)[:p]
                rest = rest[met[rest]]
                if len(rest):
                    before = np.cumsum(~own)[rest] - 1
                    lefts = (int(n[i]) - int(own.sum()) - before).astype(np.int64)
                    rows.append((doc, int(n[i]), x, mine[rest].tobytes(), lefts.tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n", "text", "prefix", "lefts"])

    return find


def _entries(buckets: int):
    """Groups with components -> packed entries, one for each shingle of the prefix."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [np.frombuffer(p, "<u8") for p in pdf["prefix"]]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            every = [np.concatenate(tokens)] + [
                np.repeat(x, size)
                for x in (pdf["g"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64),
                          np.array([t[0] for t in tokens], np.uint64), pdf["root"].to_numpy(np.int64))
            ]
            every.append(np.concatenate([np.frombuffer(x, "<i8") for x in pdf["lefts"]]))
            every.append(np.repeat(pdf["members"].to_numpy(np.int64), size))
            yield wh.packed((every[0] % np.uint64(buckets)).astype(np.int64), every)

    return find


def _buckets(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, size, meets earlier at, component, left, members) of each shingle's groups, by size."""
    s, d, n, f, c, r, m = wh.unpacked(pdf["load"].tolist(), GROUP)
    order = np.lexsort((d, n, s))
    s, d, n, f, c, r, m = (x[order] for x in (s, d, n, f, c, r, m))
    for a, z in zip(*wh.groups(s), strict=True):
        if z - a > 1:
            # groups with an equal first shingle meet in its bucket, not in later ones
            yield d[a:z], n[a:z], np.where(f[a:z] == s[a], np.uint64(0), f[a:z]), c[a:z], r[a:z], m[a:z]


def _enough(n: np.ndarray, left: np.ndarray, i, j, similar: int) -> np.ndarray:
    """Whether documents i and j can still share what similarity asks of their sizes."""
    return np.minimum(left[i], left[j]) * (100 + similar) >= similar * (n[i] + n[j])


def _near_pairs(similar: int):
    """Each group with the one before it by size and the first one it can link to."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in wh.by_bucket(batches):
            out = []
            for d, n, f, _, left, _ in _buckets(pdf):
                low = np.searchsorted(n, -(-n * similar // 100))
                for one in (np.arange(len(d)) - 1, low):
                    ok = (one >= low) & (one < np.arange(len(d))) & (one >= 0)
                    ok &= ((f[one] != f) | (f == 0)) & _enough(n, left, one, np.arange(len(d)), similar)
                    out.append(np.stack((d[one[ok]], d[ok])))
            if out:
                p = np.unique(np.sort(np.concatenate(out, 1), 0), axis=1)
                yield pd.DataFrame({"a": p[0], "b": p[1]})

    return find


def _open_of(bucket: tuple[np.ndarray, ...], similar: int) -> tuple[list[np.ndarray], bool]:
    """All pairs of groups that can link and are in two components, or that these are many."""
    d, n, f, c, left, m = bucket
    roots, which, size = np.unique(c, return_inverse=True, return_counts=True)
    low = np.searchsorted(n, -(-n * similar // 100))
    high = np.searchsorted(n, n * 100 // similar, "right")
    largest, found, out = size.argmax(), 0, []
    for i in np.flatnonzero(which != largest):
        j = np.arange(low[i], high[i])
        j = j[_enough(n, left, i, j, similar)]
        # of two outside the largest component the later one asks
        j = j[(c[j] != c[i]) & ((which[j] == largest) | (j < i)) & ((f[j] != f[i]) | (f[i] == 0))]
        if len(j):
            found += int(m[i]) * int(m[j].sum())
            if found > PAIRS_EACH * int(m.sum()):
                return [], True
            out.append(np.stack((np.minimum(d[j], d[i]), np.maximum(d[j], d[i]))))
    return out, False


def _open_pairs(similar: int):
    """Open pairs of groups; of a bucket with many, its groups, each with the bucket's first."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in wh.by_bucket(batches):
            pairs, stars = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
            for bucket in _buckets(pdf):
                d, c = bucket[0], bucket[3]
                if (c == c[0]).all():
                    continue
                some, hot = _open_of(bucket, similar)
                pairs += some
                if hot:
                    stars.append(np.stack((np.full(len(d), d.min()), d)))
            for hot, x in enumerate((pairs, stars)):
                x = np.unique(np.concatenate(x, 1), axis=1)
                yield pd.DataFrame({"a": x[0], "b": x[1], "hot": np.int32(hot)})

    return find


def _with_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text's set in place of the text."""
    for pdf in batches:
        for some, raw in wh.chunks(pdf, "text"):
            t, s = shingle_sets(raw)
            ends = np.cumsum(np.bincount(t, minlength=len(some)))
            sets = [s[a:z].tobytes() for a, z in zip(np.append(0, ends[:-1]), ends, strict=True)]
            yield some.drop(columns="text").assign(set=sets)


def overlaps(sets: list[np.ndarray], lags: int = 32, columns: int = 2048) -> np.ndarray:
    """How many elements every two sets share: rare elements pair by pair, frequent ones
    as columns of a matrix product."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    first, ends = wh.groups(value)
    size = ends - first
    shared = np.zeros((m, m), np.float32)
    rare = np.repeat((size > 1) & (size <= lags), size)
    v, r = value[rare], row[rare]
    for lag in range(1, lags):
        at = np.flatnonzero(v[lag:] == v[:-lag])
        if not len(at):
            break
        shared += np.bincount(r[at] * m + r[at + lag], minlength=m * m).reshape(m, m)
    shared += shared.T
    often = np.flatnonzero(size > lags)
    for k in range(0, len(often), columns):
        part = often[k : k + columns]
        x = np.zeros((m, len(part)), np.float32)
        for c, g in enumerate(part):
            x[row[first[g] : ends[g]], c] = 1
        shared += x @ x.T
    return shared


def _cluster_links(similar: int):
    """Two blocks of a hot cluster -> links that join the same components as all its links."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u8") for x in pdf["set"]]
        d, block = pdf["doc_id"].to_numpy(np.int64), pdf["block"].to_numpy()
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        both = overlaps(sets)
        hit = 100 * both >= similar * (n[:, None] + n[None, :] - both)
        if (block != block[0]).any():  # pairs of one block meet in that block's own task
            hit &= block[:, None] != block[None, :]
        part = np.unique(pdf["root"], return_inverse=True)[1]
        links = []
        for i in range(len(d)):
            new, at = np.unique(part[hit[i]], return_index=True)
            at = np.flatnonzero(hit[i])[at[new != part[i]]]
            links += [(d[i], d[j]) for j in at]
            part[np.isin(part, new)] = part[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return solve


def cluster_links(stars: DataFrame, members: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """Links inside clusters of groups: every pair of a cluster is looked at in one block pair."""
    where = components(stars).select(F.col("node").alias("g"), F.col("root").alias("cluster"))
    rows = materialize(members.join(where, "g").select("cluster", "doc_id", "root", "n"), "join-hot")
    most = F.expr(f"int(least({SPREAD}, ceil(count(*) / {SPREAD_LEAST})))")
    need = F.expr(f"int(greatest(ceil(count(*) / {BLOCK}), ceil(sum(n) * 8 / {BLOCK_BYTES})))")
    blocks = rows.groupBy("cluster").agg(F.greatest(most, need).alias("blocks"))
    rows = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.join(texts.select("doc_id", "text"), "doc_id").select("cluster", "doc_id", "root", "block", "blocks", "text")
    rows = rows.mapInPandas(_with_set, "cluster long, doc_id long, root long, block int, blocks int, set binary")
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return other.groupBy("cluster", "lo", "hi").applyInPandas(_cluster_links(similar), PAIRS)


def _verify(similar: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 128):
                some = pdf.iloc[lo : lo + 128]
                m = len(some)
                t, s = shingle_sets([x.encode() for x in [*some["text_a"], *some["text_b"]]])
                n = np.bincount(t, minlength=2 * m)
                order = np.lexsort((s, t % m))
                t, s = t[order] % m, s[order]
                both = np.bincount(t[1:][(t[1:] == t[:-1]) & (s[1:] == s[:-1])], minlength=m)
                ok = 100 * both >= similar * (n[:m] + n[m:] - both)
                yield some.loc[ok & (both > 0), ["a", "b"]]

    return check


def verified(pairs: DataFrame, texts: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs whose sets are similar enough."""
    t = texts.select("doc_id", "text")
    pairs = pairs.distinct()
    both = pairs.join(t.toDF("b", "text_b"), "b").join(t.toDF("a", "text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verify(similar), PAIRS)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and text_hash for every row."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, buckets // 2)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def homed(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "text").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))

    sizes = materialize(set_sizes(named), "join-sizes")
    known = sizes.filter("doc_id IS NOT NULL")
    # an id stands for its row where no two texts share one
    texts_an_id = known.groupBy("doc_id").agg((F.min("hash") < F.max("hash")).alias("many"))
    numbers = None
    if not texts_an_id.filter("many").isEmpty():
        # numbers are written once: a task that runs again reads the same ones
        numbers = known.select("doc_id", "hash").distinct().withColumn("key", F.monotonically_increasing_id())
        numbers = materialize(numbers, "join-numbers")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.col("doc_id")) if numbers is None else df.join(numbers, ["doc_id", "hash"])

    known = keyed(known)
    same = ["f1", "f2", "n"]
    least = known.filter("n > 0").groupBy(*same).agg(F.min("key").alias("least"), F.min("doc_id").alias("least_id"))
    least = materialize(least, "join-classes")
    shown = ["doc_id", "hash", "key", "n", "least"]
    classed = known.join(least, same, "left").select(*shown)
    # rows with a null id have no key: they are in no class
    none = F.lit(None).cast("long")
    nameless = sizes.filter("doc_id IS NULL").withColumns({"key": none, "least": none}).select(*shown)
    classed = materialize(classed.unionByName(nameless), "join-members")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield wh.packed(pdf["bucket"].to_numpy(np.int64), [pdf["key"].to_numpy(np.int64)], 3)

    copies = classed.filter("key > least").select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key"
    ).mapInPandas(listed, wh.PACKED)
    schema = "doc_id long, n long, text string, prefix binary, lefts binary"

    def narrowed(rows: DataFrame, share: float, name: str) -> DataFrame:
        marks = dealt(rows.mapInPandas(_marks(buckets, similar, share), wh.PACKED)).mapInPandas(_shared, wh.PACKED)
        marks = marks.unionByName(copies)
        can = rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(_candidates(similar, share), schema)
        return materialize(can, name)

    # a share of the hash range for all documents, then all of it for those that are left
    rows = keyed(named.filter("doc_id IS NOT NULL")).select(F.col("key").alias("doc_id"), "text")
    can = narrowed(homed(rows), EXAMINED, "join-candidates")
    can = narrowed(homed(can), 1.0, "join-candidates-2")
    # groups of equal prefix and size: in the first pairs the smallest key stands for all
    slim = can.select("doc_id", "n", "prefix", "lefts")
    alike = ["n", "prefix", "lefts"]
    heads = materialize(slim.groupBy(*alike).agg(F.min("doc_id").alias("g"), F.count("*").alias("members")), "join-heads")
    star = slim.join(heads, alike).filter("doc_id <> g").select(F.col("g").alias("a"), F.col("doc_id").alias("b"))
    heads = heads.withColumn("root", F.col("g"))
    near = dealt(heads.mapInPandas(_entries(buckets), wh.PACKED)).mapInPandas(_near_pairs(similar), PAIRS)
    roots = components(materialize(verified(star.unionByName(near), can, similar), "join-links"))
    # groups of equal prefix, size and component; what their members' pairs leave open
    part = slim.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    part = materialize(part, "join-parts")
    alike = [*alike, "root"]
    groups = materialize(part.groupBy(*alike).agg(F.min("doc_id").alias("g"), F.count("*").alias("members")), "join-groups")
    members = materialize(part.join(groups, alike).select("g", "doc_id", "root", "n"), "join-group-members")
    found = dealt(groups.mapInPandas(_entries(buckets), wh.PACKED)).mapInPandas(_open_pairs(similar), PAIRS + ", hot int")
    found = materialize(found, "join-open")
    more = []
    if not (pairs := found.filter("hot = 0").select("a", "b").distinct()).isEmpty():
        one, two = (members.select(F.col("g").alias(x), F.col("doc_id").alias(f"d{x}")) for x in "ab")
        pairs = pairs.join(one, "a").join(two, "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
        more.append(verified(pairs, can, similar))
    if not (stars := found.filter("hot = 1").select("a", "b")).isEmpty():
        more.append(cluster_links(stars, members, can, similar))
    if more:
        stars = roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        for links in more:
            stars = stars.unionByName(links)
        roots = components(stars)
    # the smallest id of a component: its root, unless keys are numbers
    ids = least.select("least", "least_id").join(roots.withColumnRenamed("node", "least"), "least", "left")
    ids = ids.withColumn("root", F.coalesce("root", "least"))
    small = ids.groupBy("root").agg(F.min("least_id").alias("small"))
    ids = materialize(ids.join(small, "root").select("least", "root", "small"), "join-ids")
    return classed.join(ids, "least", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("small", "doc_id").alias("component_id"),
        F.col("root").alias("class_id"), F.col("hash").alias("text_hash"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Of rows with the same id and text one stays. Rows with a null id are in no group: they
    stay, one of each text, and all of them where the text has no words. Texts without
    words are in no group either. An empty table gives an empty table.
    """
    rows = materialize(near_duplicates(docs).filter("doc_id IS NOT NULL"), "join-rows")
    count = F.count("*").alias("n")
    alone = rows.filter("class_id IS NULL").groupBy("doc_id", "text_hash").agg(count)
    first = rows.filter("class_id IS NOT NULL").groupBy("class_id", "doc_id", "text_hash").agg(count)
    first = first.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("x")).select("x.*")
    keep = materialize(first.unionByName(alone).withColumnRenamed("text_hash", "__hash"), "join-kept")
    nameless, wordless = F.col("doc_id").isNull(), ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    by = ["doc_id", "__hash"]
    once = hashed.join(keep.filter("n = 1"), by, "left_semi").select(*docs.columns)
    again = hashed.join(keep.filter("n > 1"), by, "left_semi").select(*docs.columns)
    again = again.unionByName(docs.filter(nameless & ~wordless))
    # two steps: a row that is repeated very often is first thinned out by partition
    rest = [c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    for key in (["doc_id", "text", "_salt"], ["doc_id", "text"]):
        w = Window.partitionBy(*key).orderBy(*rest)
        again = again.withColumn("_salt", F.spark_partition_id()) if "_salt" in key else again
        again = again.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return once.unionByName(again.drop("_salt")).unionByName(docs.filter(nameless & wordless))


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
