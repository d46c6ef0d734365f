"""Near duplicates of documents: MinHash bands, sequential Bayesian pruning, exact verification.

Texts of one shingle set are a class, found by a digest of the set; only classes are compared.
Bands of a class's signature put it in buckets.  Candidates of a bucket are compared in three rounds:

1. each class with the least of all bucket leaders it meets,
2. each class with the leaders of its buckets that it is not yet connected with,
3. in buckets that still hold several components, all classes outside the leader's component with all classes, in blocks of a bounded
   number of classes and shingles.  A block has its classes' shingle sets, verifies inside the task and hands on only links
   that join two of its components: less than one per class.

So a bucket of many near copies costs one comparison per class, and yet each link that
connects two components is found.  A comparison goes through the signatures in batches and ends as
soon as the posterior chance of reaching the threshold falls below a bound, chosen so that a pair of exactly the threshold
is given up with a chance of at most ``MISS`` over all batches; survivors are verified on their full shingle sets.  A signature
keeps the low 16 bits of each least hash: equal hashes stay equal, so no link is lost, and half the bytes are written and shuffled.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; rows
without id take part, but name a component only by the ids of others; equal rows
are one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.common import unpacked
from tabloom.llm.shingles import mixed, shingle_sets
from tabloom.operators.density import connected_components
from tabloom.session import staged

WIDTH = 5
PERCENT = 80
#: Bands x rows of a signature, and the hashes compared at a time.
BANDS, ROWS = 25, 5
HASHES = 256
BATCH = 32
#: What is kept of a least hash, its low bits: different ones agree in 1 of 65,536 cases, which only adds pairs to verify.
SIGN = np.uint16
#: Chance, over all batches, at which a pair of exactly the threshold may be given up before verification.
MISS = 1e-6
#: Classes and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def signature_constants(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * hashes + 1, dtype=np.uint64))
    return (numbers[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (numbers[hashes:] >> np.uint64(32)).astype(
        np.uint32
    )


def signature(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for low in range(0, len(small), 4096):
        block = small[low : low + 4096, None] ^ masks[None, :]
        block *= factors[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    return least.astype(SIGN)


def chance_given_up(percent: int, least: dict[int, int]) -> float:
    """The chance that a pair of exactly the threshold falls below the least matches at any number of hashes."""
    going, lost, at = np.ones(1), 0.0, 0
    for n, wanted in sorted(least.items()):
        batch = np.array([comb(n - at, k) * (percent / 100) ** k * (1 - percent / 100) ** (n - at - k) for k in range(n - at + 1)])
        going, at = np.convolve(going, batch), n
        lost += going[:wanted].sum()
        going[:wanted] = 0
    return float(lost)


def least_matches(percent: int, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> dict[int, int]:
    """For each number of hashes compared: the least matches at which a pair goes on.

    With m of n equal, the similarity has a Beta(m + 1, n - m + 1) posterior.  The bound on its chance is
    halved until all batches together give up a pair of exactly the threshold with at most ``miss``.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    yes, no = np.log(grid), np.log1p(-grid)
    chances = {}
    for n in range(batch, hashes + 1, batch):
        chances[n] = np.zeros(n + 1)
        for m in range(n + 1):
            log = m * yes + (n - m) * no
            density = np.exp(log - log.max())
            chances[n][m] = density[grid >= percent / 100].sum() / density.sum()
    bound = miss
    while True:
        least = {n: int(np.argmax(chance >= bound)) for n, chance in chances.items()}
        if chance_given_up(percent, least) <= miss:
            return least
        bound /= 2


def _lowered(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() for t in texts]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _hashed(width: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors, masks = signature_constants()
        for batch in batches:
            for low in range(0, len(batch), 2000):
                rows = batch.iloc[low : low + 2000]
                sizes, keys, signs = [], [], []
                for shingles in shingle_sets(_lowered(rows["text"]), width):
                    sizes.append(len(shingles))
                    keys.append(_digest(shingles) if len(shingles) else None)
                    signs.append(signature(shingles, factors, masks).tobytes() if len(shingles) else None)
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"].array, "mark": rows["mark"].array, "n_shingles": sizes, "key": keys, "sign": signs}
                )

    return work


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        signs = np.frombuffer(b"".join(batch["sign"]), dtype=SIGN).reshape(len(batch), -1).astype(np.uint64)
        keys = batch["key"].to_numpy()
        for band in range(BANDS):
            value = np.full(len(batch), band + 1, dtype=np.uint64)
            for row in range(ROWS):
                value = mixed(value * np.uint64(31) + signs[:, band * ROWS + row])
            yield pd.DataFrame({"key": keys, "bucket": value.astype(np.int64), "band": band})


def _sets(width: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 2000):
                sets = [s for s in shingle_sets(_lowered(batch["text"].iloc[low : low + 2000]), width) if len(s)]
                yield pd.DataFrame({"key": [_digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return work


def _surviving(least: dict[int, int]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            a = np.frombuffer(b"".join(batch["sign_a"]), dtype=SIGN).reshape(len(batch), -1)
            b = np.frombuffer(b"".join(batch["sign_b"]), dtype=SIGN).reshape(len(batch), -1)
            alive, matches, at = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64), 0
            for upto, wanted in sorted(least.items()):
                matches = matches + (a[alive, at:upto] == b[alive, at:upto]).sum(axis=1)
                going = matches >= wanted
                alive, matches, at = alive[going], matches[going], upto
            yield batch[["a", "b"]].iloc[alive]

    return work


class _Sets:
    """Shingle sets of a block, with shingles numbered from 0."""

    def __init__(self, sets: pd.Series):
        parts = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        known, self.numbers = np.unique(np.concatenate(parts), return_inverse=True)
        self.mark = np.zeros(len(known), dtype=bool)

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``others`` whose set reaches the threshold with that of ``x``."""
        own = self.numbers[self.starts[x] : self.starts[x] + self.sizes[x]]
        self.mark[own] = True
        sizes = self.sizes[others]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[others] - begins, sizes)
        common = np.add.reduceat(self.mark[self.numbers[at]], begins, dtype=np.int64)
        self.mark[own] = False
        return others[100 * common >= percent * (self.sizes[x] + sizes - common)]


def _spanning(least: dict[int, int], percent: int):
    """Verified links of two chunks of a bucket that join components; pairs met in several bands are left to the first band."""

    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("key").sort_values("key", ignore_index=True)
        constants = signature_constants()
        sign = np.array([signature(np.frombuffer(x, dtype=np.uint64), *constants) for x in block["shingles"]])
        sets = _Sets(block["shingles"])
        component = pd.factorize(block["root"])[0]
        chunk, stray = block["chunk"].to_numpy(), block["stray"].to_numpy(dtype=bool)
        band = int(block["band"].iloc[0])
        across = block["one"].iloc[0] != block["two"].iloc[0]
        stages = sorted(least.items())
        number = np.arange(len(block))
        first, second = [], []
        for low in range(0, len(block), 32):
            rows = number[low : low + 32]
            fit = (component[rows, None] != component[None, :]) & (rows[:, None] < number[None, :]) & (stray[rows, None] | stray[None, :])
            if across:
                fit &= chunk[rows, None] != chunk[None, :]
            if not fit.any():
                continue
            upto, wanted = stages[0]
            same = (sign[rows, None, :upto] == sign[None, :, :upto]).sum(axis=2)
            x, y = np.nonzero(fit & (same >= wanted))
            matches, x, at = same[x, y], rows[x], upto
            for upto, wanted in stages[1:]:
                matches = matches + (sign[x, at:upto] == sign[y, at:upto]).sum(axis=1)
                going, at = matches >= wanted, upto
                x, y, matches = x[going], y[going], matches[going]
            before = (sign[x, : band * ROWS] == sign[y, : band * ROWS]).reshape(len(x), band, ROWS).all(axis=2).any(axis=1)
            x, y = x[~before], y[~before]
            for one in np.unique(x).tolist():
                others = y[x == one]
                others = others[component[others] != component[one]]
                for other in sets.linked(one, others, percent).tolist() if len(others) else ():
                    if component[one] != component[other]:
                        component[component == component[other]] = component[one]
                        first.append(one)
                        second.append(other)
        keys = block["key"].to_numpy()
        return pd.DataFrame({"a": keys[first], "b": keys[second]})

    return work


def _verified(percent: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.loc[good, ["a", "b"]]

    return work


def _with_both(pairs: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(table.select(F.col("key").alias(side), F.col(column).alias(f"{name}_{side}")), side)
    return pairs


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per input row: ``doc_id``, ``mark`` (a hash of its text), ``n_shingles``, ``component_id``, ``kept``,
    and ``group``, a key of the component, null for rows without shingles.

    Two rows are linked if their shingle sets have a Jaccard similarity of at least
    ``percent`` hundredths; a component is named by its least id.
    """
    pair = "a binary, b binary"
    body = F.coalesce(ref(text).cast("string"), F.lit(""))
    wanted = docs.select(ref(key).cast("long").alias("doc_id"), body.alias("text"))
    hashed = staged(
        wanted.withColumn("mark", F.xxhash64(F.col("doc_id").isNull(), "text")).mapInPandas(
            _hashed(width), "doc_id bigint, mark bigint, n_shingles bigint, key binary, sign binary"
        )
    )
    classes = staged(
        hashed.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n_shingles"))
    )
    buckets = classes.select("key", "sign").mapInPandas(_buckets, "key binary, bucket bigint, band int")
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("leader")).filter("n > 1")
    members = staged(buckets.join(crowded, "bucket"))
    met = members.select("key").distinct()
    # The texts of the classes that meet another are read once more, by the id that stands for the class.
    ids = classes.join(met, "key").select(F.col("doc_id").alias("_id")).distinct()
    texts = wanted.join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text")
    sets = staged(
        texts.mapInPandas(_sets(width), "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    )
    least = least_matches(percent)

    def surviving(pairs: DataFrame) -> DataFrame:
        return _with_both(pairs, classes, "sign", "sign").mapInPandas(_surviving(least), pair)

    def verified(pairs: DataFrame) -> DataFrame:
        return staged(_with_both(pairs, sets, "shingles", "set").mapInPandas(_verified(percent), pair))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    first = staged(
        ordered(
            members.filter("key <> leader").groupBy("key").agg(F.min("leader").alias("y")).withColumnRenamed("key", "x")
        ).distinct()
    )
    links, nodes = verified(surviving(first)), met.withColumnRenamed("key", "id")

    def open_members() -> DataFrame:
        """Members of buckets of several components, with the component of their bucket's leader."""
        roots = staged(connected_components(links, nodes))
        placed = members.join(roots.withColumnRenamed("id", "key"), "key")
        buckets = placed.groupBy("bucket").agg(
            F.min("root").alias("_low"), F.max("root").alias("_high"), F.max(F.when(F.col("key") == F.col("leader"), F.col("root"))).alias("home")
        )
        return staged(placed.join(buckets.filter("_low <> _high").select("bucket", "home"), "bucket"))

    met_pairs = open_members().filter("root <> home").selectExpr("key as x", "leader as y")
    links = links.unionByName(verified(surviving(staged(ordered(met_pairs).distinct().join(first, ["a", "b"], "left_anti")))))

    # A bucket of two has been compared.  Of larger ones the classes outside the leader's component and those within are cut into
    # chunks; every chunk of the former meets every chunk in one task.
    # Of buckets that hold the same classes, the one of the first band is taken.
    rest = open_members().filter("n > 2").withColumn("stray", F.col("root") != F.col("home"))
    alike = rest.groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    )
    chosen = alike.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("one")).select("one.bucket")
    rest = rest.join(chosen, "bucket").join(classes.select("key", "n_shingles"), "key")
    parts = rest.groupBy("bucket").agg(
        *[
            F.greatest(F.ceil(F.sum(own) * 2 / F.lit(BLOCK)), F.ceil(F.sum(own * F.col("n_shingles")) * 2 / F.lit(BLOCK_SHINGLES))).cast("int").alias(name)
            for name, own in (("strays", F.col("stray").cast("bigint")), ("homes", (~F.col("stray")).cast("bigint")))
        ]
    )
    rest = rest.join(parts, "bucket").withColumn("_hash", F.xxhash64("key"))
    rest = rest.withColumn("chunk", F.expr("cast(if(stray, pmod(_hash, strays), strays + pmod(_hash, homes)) as int)"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0, if(stray, strays + homes, strays) - 1)")))
    blocks = rest.join(sets, "key").select(
        "bucket", "band", "key", "root", "stray", "shingles", "chunk",
        F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"),
    )
    links = links.unionByName(staged(blocks.groupBy("bucket", "one", "two").applyInPandas(_spanning(least, percent), pair)))
    roots = staged(connected_components(links, nodes)).withColumnRenamed("id", "key")
    named = classes.select("key", "doc_id").join(roots, "key")
    names = named.groupBy("root").agg(F.min("doc_id").alias("_least"))
    components = named.join(names, "root").select("key", "_least", F.col("root").alias("group")).unionByName(
        classes.join(met, "key", "left_anti").select("key", F.col("doc_id").alias("_least"), F.col("key").alias("group"))
    )
    component = F.coalesce("_least", "doc_id")
    return (
        hashed.select("doc_id", "mark", "n_shingles", "key").join(components, "key", "left")
        .select("doc_id", "mark", "n_shingles", component.alias("component_id"),
                component.eqNullSafe(F.col("doc_id")).alias("kept"), "group")
    )


def without_near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row of each component, with the columns as they were: one with the least id, of equal ids the least ``mark``.

    Rows without any word are in no component and all stay.
    """
    found = near_duplicates(docs, width, percent, text, key)
    chosen = found.filter("group is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one")
    )
    chosen = staged(chosen.select(F.coalesce("one.doc_id", F.lit(0)).alias("_doc"), F.col("one.mark").alias("_mark")))
    body = F.coalesce(ref(text).cast("string"), F.lit(""))
    number = ref(key).cast("long")
    rows = docs.select(
        F.struct(*[ref(c) for c in docs.columns]).alias("_row"), F.coalesce(number, F.lit(0)).alias("_doc"),
        F.xxhash64(number.isNull(), body).alias("_mark"), body.rlike(r"[^ \t-\x0d]").alias("_worded"),
    )
    kept = rows.filter("_worded").join(chosen, ["_doc", "_mark"], "left_semi")
    # Rows equal in id and text are combined before and after the shuffle that the join has made already.
    kept = kept.groupBy("_doc", "_mark").agg(F.first("_row").alias("_row")).select("_row")
    return unpacked(kept.unionByName(rows.filter("not _worded").select("_row")), docs.columns)
