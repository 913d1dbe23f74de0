"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Equal sets become one row of the incidence first, so copies are never paired. The product's first block holds each
row's rarest n-grams, those that size bounds leave undecided; its columns say which entries can be other than too
small, and size and position bounds discard entries there, as do parity sketches, which tell how far two sets differ
at least. The entries left accumulate their overlap over blocks of
the whole sets, and those below the bound of their sizes are discarded. Entries between classes already known to be
connected are not worked out, which keeps large groups of near copies linear; so components are exact, but links are
not counted. Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, durable, slices, text_key

WORDS, NUM, DEN = 5, 75, 100  # five words; intersection / union of at least 75 / 100
ORDERED = 1 << 20  # at most so many common n-grams are put last in the order, 16 MB; it changes work only, never results
COMMON, COUNTED = 3, 1 << 22  # sets that make an n-gram common; n-grams that one task counts, about
HOT = 200_000  # rows of a column, by the count of common n-grams, in one task; columns beyond are dealt to several
BLOCK = 1 << 16  # n-grams of a set in one block of the product, in the mean
NAMED = 24  # bits that pick out the rows whose whole sets are wanted; others that share them are dropped by a join
SKETCH = 16  # longs of parity bits
TURNS = 3  # times that classes still apart are tried against one of another component
EDGES = 1 << 18  # links that one task joins to components
CHARS = 1 << 18  # of text hashed at once
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of lower-cased bytes, and where each one begins."""
    a = np.frombuffer(raw, dtype=np.uint8)
    live = np.zeros(len(a) + 2, dtype=bool)
    live[1:-1] = ~_SPACE[a]
    edges = np.flatnonzero(live[1:] != live[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    power = np.cumprod(np.full(int(sizes.max()), _M1, dtype=np.uint64))
    at = np.flatnonzero(live[1:-1])
    place = at - np.repeat(starts, sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return _mix(np.add.reduceat(_BYTES[a[at]] * power[place], first) + sizes.astype(np.uint64)), starts


def _chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of that many words."""
    acc = np.full(len(hashes) - width + 1, np.uint64(width))
    for i in range(width):
        acc = _mix(acc) + hashes[i : i + len(acc)]
    return _mix(acc).view(np.int64)


def _sorted_set(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def _of_words(words: np.ndarray) -> np.ndarray:
    return _sorted_set(_chain(words, min(WORDS, len(words)))) if len(words) else np.zeros(0, dtype=np.int64)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces that end before a white space."""
    begin = 0
    while begin < len(raw):
        end = begin + CHARS
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[begin:end]
        begin = end


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles as 64-bit hashes; none without words. Short texts are hashed together."""
    raws, held = [], 0
    for k, text in enumerate(texts):
        raws.append((text or "").encode("utf-8", "surrogatepass").lower())
        held += len(raws[-1]) + 1
        if held < CHARS and k < len(texts) - 1:
            continue
        if held > 4 * CHARS:
            yield from (_of_words(np.concatenate([np.zeros(0, np.uint64), *(word_hashes(p)[0] for p in _pieces(raw))])) for raw in raws)
        else:
            words, starts = word_hashes(b" ".join(raws))
            ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))
            runs = _chain(words, WORDS) if len(words) >= WORDS else None
            begin = 0
            for end in ends.tolist():
                yield _sorted_set(runs[begin : end - WORDS + 1]) if end - begin >= WORDS else _of_words(words[begin:end])
                begin = end
        raws, held = [], 0


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the number of n-grams in each of some buckets; two sets differ in at least as many n-grams as bits."""
    odd = np.bincount((s >> 40) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart() -> Column:
    """The bits that differ between the sketches x0, x1, ... and y0, y1, ..."""
    return sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))).cast("long") for i in range(1, SKETCH)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))).cast("long"))


def _alike(na: str, nb: str) -> Column:
    """Whether the sketches x0, x1, ... and y0, y1, ... leave room for the wanted overlap of sets of these sizes."""
    return _apart() * (DEN + NUM) <= (F.col(na) + F.col(nb)) * (DEN - NUM)


def _sketches(nodes: DataFrame, node: str, side: str) -> DataFrame:
    return nodes.select(F.col("node").alias(node), *[F.col("sketch")[i].alias(f"{side}{i}") for i in range(SKETCH)])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents: id, key, size, digest and sketch of the set."""
    for batch in slices(batches):
        sizes, digests, sketches = [], [], []
        for s in shingle_sets(batch.column(2).to_pylist()):
            sizes.append(len(s))
            digests.append(_digest(s))
            sketches.append(_sketch(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "key", "n", "digest", "sketch"])


def _common(docs: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """value, n: the first 32 bits of n-grams that COMMON or more classes share.

    Copies are left out by the bits of their classes' first rows; where many rows share these bits some copies count.

    A task sends its n-grams as sorted runs of differences, two bytes each, one run for each block of values; there are
    as many blocks as keep each one's n-grams, all documents', within some COUNTED.
    """
    bits = max(4, (total // COUNTED).bit_length())
    firsts = docs.sparkSession.sparkContext.broadcast(_bits(nodes))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            seen, held = set(), []
            chosen = _chosen(np.frombuffer(firsts.value, dtype=np.uint8), batch.column(0).to_numpy())
            for s in shingle_sets(batch.column(1).take(pa.array(chosen)).to_pylist()):
                if (d := _digest(s)) and d not in seen:
                    seen.add(d)
                    held.append((s.view(np.uint64) >> np.uint64(32)).astype(np.uint32))
            if not held:
                continue
            values = np.sort(np.concatenate(held))
            edges = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
            blocks, runs = [], []
            for k in np.flatnonzero(np.diff(edges)):
                steps = np.diff(values[edges[k] : edges[k + 1]], prepend=np.uint32(k << (32 - bits)))
                narrow = int(steps.max()) < 1 << 16
                blocks.append(int(k))
                runs.append((b"2" if narrow else b"4") + steps.astype(np.uint16 if narrow else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(runs, pa.binary())], ["block", "run"])

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        start = int(key[0]) << (32 - bits)
        parts = [np.cumsum(np.frombuffer(r, np.uint16 if r[:1] == b"2" else np.uint32, offset=1), dtype=np.uint32) + np.uint32(start) for r in rows["run"]]
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        often = n >= COMMON
        return pd.DataFrame({"value": values[often].astype(np.int64), "n": n[often]})

    runs_of = docs.select(_name("doc_id", "key").alias("name"), "text").where(F.col("text").isNotNull()).mapInArrow(runs, "block long, run binary")
    return runs_of.groupBy("block").applyInPandas(count, "value long, n long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to an edge from each of their nodes to the smallest that it reaches over them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    apart = [(x, y) for x in list(root) if (y := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in apart], pa.int64()), pa.array([y for _, y in apart], pa.int64())], ["a", "b"])


def _components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over pairs (a, b).

    Tasks of at most some EDGES edges join their own; where there are several, alternating large and small stars join theirs.
    """
    tasks = -(-pairs.count() // EDGES) or 1
    edges = durable(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(tasks).mapInArrow(_forest, "a long, b long"))
    while tasks > 1:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break  # stars alone
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        edges = durable(small.where("a > b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _first() -> Column:
    """The row (doc_id, key) that leads a group: the smallest doc_id, null last, and of one id's texts the smallest key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")


def _name(doc_id: str, key: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(key))


def _bits(wanted: DataFrame) -> bytes:
    """A fixed number of bits, 2 MB, in which the names of wanted rows are set."""
    at = F.pmod("name", F.lit(1 << NAMED))
    marked = wanted.select(F.shiftright(at, 15).alias("slice"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros((1 << (NAMED - 15), 4096), dtype=np.uint8)  # 2 MB, whatever the input
    for r in marked:
        bits[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits.tobytes()


def _chosen(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The places of names whose bit is set."""
    p = names & ((1 << NAMED) - 1)
    return np.flatnonzero(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1)


def _levels(n: int) -> int:
    """A set of n n-grams has 2 to this power of blocks."""
    return ((n - 1) // BLOCK).bit_length()


def _blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, digest, level, block and grams of the sets of wanted (name), in blocks of hashes.

    A set comes with the blocks of its own size and, where a larger partner would have more, with those too. A fixed
    number of bits picks out the rows to send; what they let through beside finds no partner in the product.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bits(wanted))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in slices(batches):
            names = batch.column(0).to_numpy()
            rows = _chosen(bits, names)
            out = [[], [], [], [], []]
            for i, s in zip(rows, shingle_sets(batch.column(1).take(pa.array(rows)).to_pylist()), strict=True):
                digest = _digest(s)
                for level in {_levels(len(s)), _levels(4 * len(s) // 3)} if digest else ():
                    which = s >> (64 - level) if level else np.zeros(len(s), dtype=np.int64)
                    edges = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1], [True])))
                    for b, e in zip(edges[:-1], edges[1:], strict=True):
                        for column, value in zip(out, (names[i], digest, level, which[b], s[b:e]), strict=True):
                            column.append(value)
            *rest, grams = out
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, grams)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.binary(), pa.int32(), pa.int64()), strict=True)], lists], ["name", "digest", "level", "block", "grams"])

    sets = docs.select(_name("doc_id", "key").alias("name"), "text").where(F.col("text").isNotNull()).mapInArrow(cut, "name long, digest binary, level int, block long, grams array<long>")
    return sets.groupBy("name", "digest", "level", "block").agg(F.first("grams").alias("grams"))


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries (a, b, na, nb) whose overlap, summed over the blocks of the product, reaches the bound.

    Sets are dealt once, by the keys of both joins; then those of b go to those of a.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _blocks(docs, nodes.join(ends, "node").select("name"))
    level = F.greatest(F.floor((F.greatest("na", "nb") - 1) / BLOCK), F.lit(0)).cast("long")
    half = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.expr("shiftleft(1L, level - 1)")).cast("long")
    cells = pairs.withColumn("level", F.when(level == 0, 0).otherwise(F.length(F.bin(level))).cast("int"))
    cells = cells.withColumn("block", F.explode(F.sequence(-half, F.greatest(half - 1, F.lit(0).cast("long")))))
    for side in ("a", "b"):
        cells = cells.join(nodes.select(F.col("node").alias(side), F.col("name").alias(f"name_{side}"), F.col("digest").alias(f"digest_{side}")), side)
    for side in ("b", "a"):
        ours = sets.select(F.col("name").alias(f"name_{side}"), F.col("digest").alias(f"digest_{side}"), "level", "block", F.col("grams").alias(f"g{side}"))
        cells = cells.join(ours, [f"name_{side}", f"digest_{side}", "level", "block"]).drop(f"name_{side}", f"digest_{side}")
    total = cells.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("k")).groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return total.where(F.col("k") * DEN >= (F.col("na") + F.col("nb") - F.col("k")) * NUM).select("a", "b")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, part, parts, node, n, at), sorted by gram, part and node, of columns that hold more than one row.

    Each goes with the column's first row (b, nb, atb). One row is held from a batch to the next.
    """
    names = ["gram", "part", "parts", "node", "n", "at", "b", "nb", "atb"]
    lead, alone = None, False  # the running column's first row, and whether it has not been sent yet
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        if lead is not None:
            rows = np.concatenate((lead[None], rows))
        new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(rows)))
        send = np.repeat((sizes > 1) | (rows[first, 2] > 1), sizes)
        if sizes[-1] == 1:
            send[-1] = False  # decided with the next batch
        if lead is not None and not alone:
            send[0] = False
        led = rows[np.repeat(first, sizes)]
        lead, alone = rows[first[-1]].copy(), bool(sizes[-1] == 1 and (len(first) > 1 or alone or lead is None))
        if send.any():
            out = np.concatenate((rows[send], led[send][:, 3:]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(len(names))], names)
    if alone and lead[2] > 1:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in (*lead, *lead[3:])], names)


def _sized(na: str, nb: str) -> Column:
    return (F.col(na) * DEN >= F.col(nb) * NUM) & (F.col(nb) * DEN >= F.col(na) * NUM)


def _fits(na: str, nb: str, ia: str, ib: str) -> Column:
    """Size bounds, and what can follow the first n-gram that two sets share."""
    most = F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib))
    return _sized(na, nb) & (most * (DEN + NUM) >= NUM * (F.col(na) + F.col(nb)))


def _ordered(a: str, b: str, na: str, nb: str) -> list[Column]:
    """a, b, na and nb of a pair, the larger node first."""
    first = F.col(a) > F.col(b)
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.when(first, F.col(na)).otherwise(F.col(nb)).alias("na"), F.when(first, F.col(nb)).otherwise(F.col(na)).alias("nb")]


def _joined(roots: DataFrame, links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """roots (node, root), their components joined by links (a, b) between nodes of different ones."""
    ours = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    between = links.join(ours("a"), "a", "left").join(ours("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    above = tables.write(name, _components(between))
    inside = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return inside.union(above.join(roots.select("node"), "node", "left_anti"))


def _components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, key, n, digest of the set, or null without shingles), and of digests with the first row of their component.

    A row is named by its doc_id and its text's key, never by doc_id alone, and a class by a number of its own.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("key"))
    rows = tables.write("rows", docs.select("doc_id", "key", "text").mapInArrow(_profile, "doc_id long, key binary, n long, digest binary, sketch array<long>"))
    firsts = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(_first(), F.max("n").cast("int").alias("n"), F.first("sketch").alias("sketch"))
    nodes = firsts.select("digest", "first.doc_id", "first.key", "n", "sketch", _name("first.doc_id", "first.key").alias("name"))
    nodes = tables.write("nodes", nodes.withColumn("node", F.monotonically_increasing_id()))
    common = tables.write("common", _common(docs, nodes, nodes.agg(F.sum("n")).first()[0] or 0))
    # the counts from which on there are few enough, by eighths of an octave: at most some 500 rows
    level = F.floor(F.log2("n") * 8).cast("int")
    least, held = 0, 0
    for r in sorted(common.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):
        held += r["k"]
        if held > ORDERED:
            least = r["level"] + 1
            break
    ranked = common.where(level >= least).toArrow()
    values, n = ranked["value"].to_numpy(), ranked["n"].to_numpy()
    order = np.lexsort((values, n))  # the most common last
    values, n = values[order], n[order]
    by_value = np.argsort(values)
    shared = docs.sparkSession.sparkContext.broadcast((values[by_value].astype(np.uint32), (by_value + 1).astype(np.int32)))
    often = np.flatnonzero(n > HOT)
    hot = docs.sparkSession.createDataFrame([(int(values[i]), -(-int(n[i]) // HOT)) for i in often], "value long, parts long")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        for batch in slices(batches):
            digests, taken, seen = [], [], set()
            for s in shingle_sets(batch.column(0).to_pylist()):
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                value = (s.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                order = np.zeros(len(s), dtype=np.int32)
                if len(known):
                    i = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    order = np.where(known[i] == value, places[i], 0)
                take = len(s) + (-NUM * len(s)) // DEN + 1
                digests.append(d)
                taken.append(s[np.argsort(order, kind="stable")[:take]])
            offsets = np.cumsum([0, *map(len, taken)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *taken])))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), grams], ["digest", "prefix"])

    first_block = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(prefixes, "digest binary, prefix array<long>").dropDuplicates(["digest"])
    cells = first_block.join(nodes.select("digest", "node", "n"), "digest").select("node", "n", F.posexplode("prefix").alias("at", "gram"))
    top = F.shiftrightunsigned("gram", 32)
    cells = cells.withColumn("value", top).join(F.broadcast(hot), "value", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) if len(often) else cells.withColumn("parts", F.lit(1).cast("long"))
    cells = cells.select("gram", F.pmod(F.xxhash64("node"), "parts").alias("part"), "parts", "node", "n", "at")
    cells = cells.repartition("gram", "part").sortWithinPartitions("gram", "part", "node")
    columns = tables.write("columns", cells.mapInArrow(_columns, "gram long, part long, parts long, node long, n long, at long, b long, nb long, atb long"))

    led = columns.where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "b", "nb", F.col("atb").alias("ib"))
    heads = columns.where(F.col("parts") > 1).select("gram", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("atb").alias("ia")).distinct()
    over = heads.groupBy("gram").agg(F.min(F.struct("a", "na", "ia")).alias("m")).select("gram", F.col("m.a").alias("b"), F.col("m.na").alias("nb"), F.col("m.ia").alias("ib"))
    led = led.union(heads.join(over, "gram").where(F.col("a") != F.col("b")).select("a", "na", "ia", "b", "nb", "ib"))
    stars = tables.write("stars", led.where(_fits("na", "nb", "ia", "ib")).select(*_ordered("a", "b", "na", "nb")).distinct())
    near = stars.join(_sketches(nodes, "a", "x"), "a").join(_sketches(nodes, "b", "y"), "b").where(_alike("na", "nb")).select("a", "b", "na", "nb")
    links = tables.write("links", _linked(tables.write("near", near), docs, nodes))
    roots = tables.write("roots", _components(links))

    # what the stars leave apart is tried before any pair of a column: each column draws a row, anew in each turn, most
    # often one of the component that holds most of its rows, and of all such pairs between two components the one
    # with the nearest sketches is tried; a column of two rows has no other pair than its star
    tested = stars.select("a", "b")
    bits = [f"x{i}" for i in range(SKETCH)]
    many = columns.groupBy("gram").agg(F.count("*").alias("k")).where("k > 2").select("gram")
    wide = tables.write("wide", columns.join(many, "gram").select("gram", "node", "n", "at"))
    tables.drop("columns")
    named = lambda: wide.join(roots, "node", "left").select("gram", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    for turn in range(TURNS):
        row = F.struct(F.xxhash64("node", "gram", F.lit(turn)).alias("h"), "root", "node", "n")
        leads = named().groupBy("gram").agg(F.min(row).alias("to"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram", "to")
        away = named().join(leads, "gram").where("root <> to.root").select("node", "n", F.col("to.node").alias("other"), F.col("to.n").alias("m"), F.least("root", "to.root").alias("lo"), F.greatest("root", "to.root").alias("hi"))
        close = away.where(_sized("n", "m")).distinct().join(_sketches(nodes, "node", "x"), "node").join(_sketches(nodes, "other", "y"), "other").where(_alike("n", "m"))
        close = close.select("lo", "hi", _apart().alias("apart"), *_ordered("node", "other", "n", "m")).join(tested, ["a", "b"], "left_anti")
        nearest = close.groupBy("lo", "hi").agg(F.min(F.struct("apart", "a", "b", "na", "nb")).alias("pair"))
        fresh = tables.write(f"apart{turn}", nearest.select("pair.a", "pair.b", "pair.na", "pair.nb"))
        if fresh.isEmpty():
            break
        found = tables.write(f"found{turn}", _linked(fresh, docs, nodes))
        tested = tested.union(fresh.select("a", "b"))
        if found.isEmpty():
            break
        roots = tables.write(f"roots{turn}", _joined(roots, found, tables, f"above{turn}"))

    # the entries between classes that are still apart
    split = named().groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    open_cells = named().join(split, "gram").join(_sketches(nodes, "node", "x"), "node")
    x = open_cells.select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("root").alias("ra"), *bits)
    y = open_cells.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("root").alias("rb"), *[F.col(c).alias(c.replace("x", "y")) for c in bits])
    rest = x.join(y, "gram").where((F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & _fits("na", "nb", "ia", "ib") & _alike("na", "nb")).select("a", "b", "na", "nb").distinct()
    rest = tables.write("rest", rest.join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty() and not (more := tables.write("more", _linked(rest, docs, nodes))).isEmpty():
        roots = tables.write("last", _joined(roots, more, tables, "above"))

    of_class = tables.write("classes", nodes.join(roots, "node", "left").select("digest", "doc_id", "key", F.coalesce("root", "node").alias("root")))
    firsts = of_class.groupBy("root").agg(_first())
    found = tables.write("found", of_class.select("digest", "root").join(firsts, "root").select("digest", "first"))
    turns = [f"{name}{turn}" for turn in range(TURNS) for name in ("apart", "found", "roots", "above")]
    for name in ("common", "above", "nodes", "wide", "stars", "near", "links", "roots", "rest", "more", "last", "classes", *turns):
        tables.drop(name)
    return rows.drop("sketch"), found


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for each input row.

    Null, empty and wordless texts have no shingles and stand alone. Rows of equal sets, repeated rows among them, are
    one class; rows that share an id alone are not. component_id is the smallest doc_id of a row's component. A null
    doc_id stays null and takes part as the largest id would: a component of null ids has a null component_id. Other
    columns are not read.
    """
    rows, found = _components_of(docs)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.join(found, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with the first row of each component: the smallest doc_id, null last.

    Of rows with that doc_id and the same text one stays. Texts without words stand alone: all of them stay, but for
    repeats of a text under one id; a null id tells of no repeat.
    """
    first = _components_of(docs)[1].select(F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("key"), F.lit(True).alias("is_first")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash with those below
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    marked = docs.select(whole, F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), wordless.alias("wordless"))
    marked = marked.withColumn("alone", F.when(F.col("wordless") & F.col("id").isNull(), F.monotonically_increasing_id()))
    kept = marked.join(first, "key", "left").where(F.col("wordless") | (F.col("is_first") & F.col("id").eqNullSafe(F.col("first_id"))))
    return kept.dropDuplicates(["id", "key", "alone"]).select("row.*")
