"""Entity resolution: keep-first, best-of-group, canonical keys and exact greedy fuzzy groups."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.operators import blocks

#: Words without weight in a canonical key. Fixed values.
NOISE = ("m/f/x", "m/f", "m w d", "junior", "senior", "medior")


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in the order; Spark keeps only the first row of a group per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def best_order(description: str = "description", created: str = "created", salary: Column | None = None, source_rank: str | None = None, row_id: str = "row_id") -> list[Column]:
    """Longer description, later date (any before none), a salary, preferred source, first row."""
    out = [F.desc(F.length(F.trim(F.coalesce(F.col(description), F.lit(""))))), F.desc_nulls_last(created)]
    if salary is not None:
        out.append(F.desc(salary.isNotNull().cast("int")))
    if source_rank:
        out.append(F.asc(source_rank))
    return [*out, F.asc(row_id)]


def _best_of(df: DataFrame) -> list[Column]:
    """best_order() with the salary and the preference of sources, where the table has them."""
    pay = [F.col(c) for c in ("salary_min", "salary_max") if c in df.columns]
    return best_order(salary=F.coalesce(*pay) if pay else None, source_rank="source_rank" if "source_rank" in df.columns else None)


def by_url(df: DataFrame) -> DataFrame:
    """The best row of each url; rows without one all stay."""
    has = F.coalesce(F.trim("url"), F.lit("")) != ""
    return keep_first(df.where(has), ["url"], _best_of(df)).unionByName(df.where(~has))


def canonical_key(df: DataFrame) -> Column:
    """Company, title and place in simple form without noise words; where nothing is left, title and company as they are."""
    whole = T.simple_key(F.concat_ws(" ", *[T.strip_noise(F.col(c), NOISE) for c in ("company", "title", "location")]))
    return F.when(whole != "", whole).otherwise(T.simple_key(F.concat_ws(" ", "title", "company")))


def by_canonical_key(df: DataFrame) -> DataFrame:
    return keep_first(df.withColumn("key", canonical_key(df)), ["key"], _best_of(df))


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / total length), by the longest common subsequence (bit-parallel)."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:
        hit = state & where.get(c, 0)
        state = (state + hit | state - hit) & full
    common = len(a) - bin(state).count("1")
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best indel ratio of the common tokens and each side's, as token-set matching defines it."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [indel_ratio(one, two)]
    if both:
        scores += [indel_ratio(both, one), indel_ratio(both, two)]
    return max(scores)


def _rare_first(keys: DataFrame, column: str, item: str) -> DataFrame:
    """keys with `column`, an array, in the order of how many keys have each item, rare ones first."""
    flat = keys.select("first", F.explode(column).alias(item))
    counts = flat.groupBy(item).agg(F.count("*").alias("n"))
    ordered = flat.join(counts, item).groupBy("first").agg(F.array_sort(F.collect_list(F.struct("n", item))).alias("o"))
    return keys.drop(column).join(ordered.select("first", F.col("o")[item].alias(column)), "first")


#: Keys of a block of names, of a group inside it, pairs that a worker verifies at once, and characters that names in simple form have.
NAMES, GROUP, VERIFIED, CHARACTERS = 8192, 64, 1 << 18, " abcdefghijklmnopqrstuvwxyz0123456789"
#: Bits of a signature for each character, as many as it is often; tokens and characters beyond which a name is compared on its own.
LEVELS, TOKENS, LETTERS = 5, 8, 64
#: Keys of the first batch of the greedy pass, how many times as many there are with each further one, and pairs that one task settles.
FIRST, GROWTH, PAIRS = 1 << 16, 4, 1 << 21


def _name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, size, first, whole) in the order of place and size as blocks of one place."""
    part, number = TaskContext.get().partitionId(), itertools.count()
    rows: list[tuple[int, int, str]] = []
    here = None

    def block() -> pa.RecordBatch:
        firsts = np.array([f for _, f, _ in rows], np.int64)
        row = ([part << 32 | next(number)], [here], [rows[0][0]], [rows[-1][0]], [firsts.tobytes()], ["\n".join(w for _, _, w in rows)])
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["id", "place", "lo", "hi", "firsts", "names"])

    for batch in batches:
        for place, size, first, whole in zip(*(batch.column(c).to_pylist() for c in ("place", "size", "first", "whole")), strict=True):
            if rows and (place != here or len(rows) >= NAMES):
                yield block()
            here = place
            rows.append((size, first, whole))
    if rows:
        yield block()


_CODE = np.full(256, len(CHARACTERS), np.uint8)
_CODE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(len(CHARACTERS))


class Names:
    """A block of names, each its sorted tokens: counts of characters, signatures of them, bounds on them by groups of rows."""

    def __init__(self, firsts: bytes, names: str):
        self.first = np.frombuffer(firsts, np.int64)
        self.texts = names.split("\n")
        self.size = np.array([len(t) for t in self.texts], np.int64)
        n, width = len(self.texts), len(CHARACTERS) + 1
        owner = np.repeat(np.arange(n), self.size)
        flat = _CODE[np.frombuffer("".join(self.texts).encode(), np.uint8)]
        self.bags = np.bincount(owner * width + flat, minlength=n * width).reshape(n, width)[:, :-1].astype(np.int32)
        bits = np.packbits((self.bags[:, :, None] > np.arange(LEVELS)).reshape(n, -1), axis=1)
        self.signs = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64).T)
        at = np.arange(0, n, GROUP)
        self.low, self.high, self.most = np.minimum.reduceat(self.bags, at), np.maximum.reduceat(self.bags, at), np.maximum.reduceat(self.size, at)

    def number(self, known: dict[str, int], none: int) -> None:
        """A row of numbers of tokens for each name, `none` behind the last; wide: names of too many tokens."""
        self.split = [t.split(" ") for t in self.texts]
        self.wide = np.array([len(t) > TOKENS for t in self.split])
        self.tokens = np.full((len(self.split), min(TOKENS, max(map(len, self.split)))), none, np.int32)
        for i, own in enumerate(self.split):
            for j, t in enumerate(own[:TOKENS]):
                self.tokens[i, j] = known.setdefault(t, len(known))

    def rest(self, rows: np.ndarray, common: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The different texts that are left of the rows without the tokens marked, and the place of each row's among them."""
        bits = ((~common & (self.tokens[rows] >= 0)) << np.arange(common.shape[1])).sum(axis=1)
        keys, at = np.unique(rows << TOKENS | bits, return_inverse=True)
        return [" ".join(t for j, t in enumerate(self.split[k >> TOKENS]) if j >= TOKENS or k >> j & 1) for k in keys.tolist()], at


def _near_rows(one: Names, two: Names, same: bool, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of two blocks whose characters differ in at most that share; a group is only met where its bounds let it."""
    for g in range(len(one.most)):
        apart = (np.maximum(two.low - one.high[g], 0) + np.maximum(one.low[g] - two.high, 0)).sum(axis=1)
        groups = np.flatnonzero(apart <= miss * (one.most[g] + two.most) + 1e-9)
        if same:
            groups = groups[groups >= g]
        columns = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
        columns = columns[columns < len(two.size)]
        if not len(columns):
            continue
        start = g * GROUP
        differ = sum(np.bitwise_count(x[start : start + GROUP, None] ^ y[columns]) for x, y in zip(one.signs, two.signs, strict=True))
        most = np.minimum(miss * (one.most[g] + two.size[columns]) + 1e-9, 255).astype(np.uint8)
        i, j = np.nonzero(differ <= most)
        i, j = i + start, columns[j]
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            good = np.abs(one.bags[x] - two.bags[y]).sum(axis=1) <= miss * (one.size[x] + two.size[y]) + 1e-9
            yield x[good], y[good]


def _common_letters(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each left[i] and right[j], of at most 64 characters; bit-parallel, as indel_ratio()."""
    coded = []
    for texts in (left, right):
        sizes = np.array([len(t) for t in texts])
        chars = np.full((len(texts), int(sizes.max())), len(CHARACTERS), np.uint8)
        chars[np.arange(chars.shape[1]) < sizes[:, None]] = _CODE[np.frombuffer("".join(texts).encode(), np.uint8)]
        coded.append((sizes, chars))
    (sizes, chars), (_, steps) = coded
    where = np.zeros((len(left), len(CHARACTERS) + 1), np.uint64)
    for k in range(chars.shape[1]):
        where[np.arange(len(left)), chars[:, k]] |= np.uint64(1 << k)
    where[:, -1] = 0
    state = np.full(len(i), ~np.uint64(0))
    for k in range(steps.shape[1]):
        hit = state & where[i, steps[j, k]]
        state = (state + hit) | (state - hit)
    full = np.array([(1 << n) - 1 for n in sizes.tolist()], np.uint64)
    return np.bitwise_count(~state & full[i]).astype(np.int64)


def _alike(one: Names, two: Names, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the pairs of rows match by the common tokens before each side's, or by one side's tokens being among the other's."""
    a, b = one.tokens[i], two.tokens[j]
    equal = a[:, :, None] == b[:, None, :]
    (left, x), (right, y) = one.rest(i, equal.any(axis=2)), two.rest(j, equal.any(axis=1))
    nx, ny = (np.array([len(t) for t in texts]) for texts in (left, right))
    odd = one.wide[i] | two.wide[j] | (nx[x] > LETTERS) | (ny[y] > LETTERS)
    short = lambda texts: [t if len(t) <= LETTERS else "" for t in texts]
    # a common beginning is common to the longest common subsequence
    common = _common_letters(short(left), short(right), x, y) + one.size[i] - nx[x]
    good = (nx[x] == 0) | (ny[y] == 0) | (200.0 * common / (one.size[i] + two.size[j]) >= least)
    for k in np.flatnonzero(odd).tolist():
        good[k] = token_set_ratio(one.texts[i[k]], two.texts[j[k]]) >= least
    return good


def _near_bags(miss: float, least: float | None, met: bool):
    """Pairs of keys of two blocks whose characters differ in at most that share; with `least`, those of at least that ratio by _alike(). met: blocks of one table."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one, two = (Names(batch.column(f"firsts{k}")[r].as_py(), batch.column(f"names{k}")[r].as_py()) for k in "ab")
                if least is not None:
                    known: dict[str, int] = {}
                    one.number(known, -1)
                    two.number(known, -2)

                def told(held: list[tuple[np.ndarray, np.ndarray]], one=one, two=two) -> pa.RecordBatch:
                    i, j = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                    held.clear()
                    if least is not None and len(i):
                        good = _alike(one, two, i, j, least)
                        i, j = i[good], j[good]
                    x, y = one.first[i], two.first[j]
                    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

                held, many = [], 0
                for rows in _near_rows(one, two, met and batch.column("ida")[r] == batch.column("idb")[r], miss):
                    held.append(rows)
                    many += len(rows[0])
                    if many >= VERIFIED:
                        yield told(held)
                        many = 0
                if held:
                    yield told(held)

    return near


def _blocks_of(keys: DataFrame) -> DataFrame:
    """keys as blocks of names of one place; in the order of their characters, so that names of a group are alike."""
    letters = F.array_join(F.sort_array(F.split("whole", ""), asc=False), "")
    packed = keys.where("size > 0").select("place", "size", F.col("first").cast("long").alias("first"), "whole", letters.alias("letters"))
    packed = packed.repartitionByRange("place", "size", "letters").sortWithinPartitions("place", "size", "letters").drop("letters")
    return blocks.kept(packed.mapInArrow(_name_blocks, "id long, place string, lo int, hi int, firsts binary, names string"), "names")


def _by_bags(keys: DataFrame, places: DataFrame, miss: float, least: float | None = None, others: DataFrame | None = None) -> DataFrame:
    """a, b: keys (first, place, whole, size) whose characters are near each other's and whose places are among the pairs pa, pb.

    With `least` only those that match, see _alike(). With `others` (keys too) each pair is of one of keys and one of others.
    """
    blocks.bounded(keys.sparkSession)
    made = _blocks_of(keys)
    made = made, made if others is None else _blocks_of(others)
    one, two = (m.select(*[F.col(c).alias(f"{c}{k}") for c in m.columns]) for m, k in zip(made, ("a", "b"), strict=True))
    ratio = (1 + miss) / (1 - miss) + 1e-6
    met = one.join(places, F.col("placea") == F.col("pa")).join(two, F.col("placeb") == F.col("pb")).where((F.col("loa") <= ratio * F.col("hib")) & (F.col("lob") <= ratio * F.col("hia")))
    if others is None:
        met = met.where("ida <= idb")
    # one pair of blocks is much work, so each goes to a partition by itself as far as there are any
    dealt = met.select("ida", "idb", *[f"{c}{k}" for k in ("a", "b") for c in ("firsts", "names")]).repartition("ida", "idb")
    return dealt.mapInArrow(_near_bags(miss, least, others is None), "a long, b long")


def _by_tokens(words: DataFrame, miss: float, others: DataFrame | None = None) -> DataFrame:
    """a, b: keys (first, tokens in any order, the rare ones first, size) of which one has a first token of the other; see fuzzy_matches().

    With `others` (keys too) each pair is of one of keys and one of others."""
    room = 2 * miss / (1 + miss)
    before = lambda i: F.aggregate(F.slice("tokens", F.lit(1), i), F.lit(0), lambda n, t: n + F.length(t))
    probes = lambda df: df.select("first", F.explode(F.filter(F.col("tokens"), lambda t, i: before(i) <= room * F.col("size") + 1e-9)).alias("token"))
    every = lambda df: df.select(F.col("first").alias("other"), F.explode("tokens").alias("token"))
    met = lambda one, two: probes(one).join(every(two), "token").where("first <> other").select(F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b"))
    pairs = met(words, words) if others is None else met(words, others).unionAll(met(others, words))
    return pairs.distinct()


def _sorted_tokens(keys: DataFrame, column: str) -> DataFrame:
    """keys with tokens, whole (the sorted tokens as one text) and size of a column in simple form."""
    tokens = F.sort_array(F.array_distinct(F.filter(F.split(column, " "), lambda t: t != "")))
    return keys.withColumn("tokens", tokens).withColumn("whole", F.array_join("tokens", " ")).withColumn("size", F.length("whole"))


def _ratio(a: str, b: str) -> Column:
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(ratio, "double")(a, b)


def _places(keys: DataFrame, place: float) -> DataFrame:
    """pa, pb, in both orders: places of keys that are alike: equal, either empty, or near each other. No place is compared twice."""
    every = blocks.kept(keys.select("place").distinct().withColumn("first", F.monotonically_increasing_id()), "places")
    alone = _sorted_tokens(every, "place")
    whole = every.agg(F.lit("").alias("pa")).crossJoin(every.agg(F.lit("").alias("pb")))
    words = _rare_first(alone.select("first", "size", "tokens"), "tokens", "token")
    near = _by_bags(alone.withColumn("place", F.lit("")), whole, 1 - place / 100).unionAll(_by_tokens(words, 1 - place / 100)).distinct()
    one, two = (every.select(F.col("first").alias(k), F.col("place").alias(f"p{k}")) for k in ("a", "b"))
    alike = near.join(one, "a").join(two, "b").where("pa <> '' AND pb <> ''").where(_ratio("pa", "pb") >= place).select("pa", "pb")
    equal = every.select(F.col("place").alias("pa"), F.col("place").alias("pb"))
    empty = every.where("place <> ''").select(F.lit("").alias("pa"), F.col("place").alias("pb"))
    return equal.unionAll(alike).unionAll(alike.select(F.col("pb").alias("pa"), F.col("pa").alias("pb"))).unionAll(empty).unionAll(empty.select("pb", "pa").toDF("pa", "pb"))


def _cut(df: DataFrame) -> DataFrame:
    """df below the folder that the cluster names in spark.checkpoint.dir; without one a cluster is refused."""
    return blocks.kept(df, "cut")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first_matches() of all pairs in one task."""
    held = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches if x.num_rows]
    if not held:
        return
    a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    keys = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(keys, a), np.searchsorted(keys, b)
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    group = np.arange(len(keys))
    starts = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
        near = a[lo:hi]
        near = near[group[near] == near]
        if len(near):
            group[b[lo]] = near[0]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[group])], names=["key", "group"])


def first_matches(pairs: DataFrame) -> DataFrame:
    """key, group: what a greedy pass in ascending order makes of pairs (a, b), a < b: each key joins the lowest kept key
    that it matches, and is kept if there is none. A key is settled in the round after all lower ones that decide it."""
    pairs = _cut(pairs)
    if pairs.count() <= PAIRS:
        return pairs.coalesce(1).mapInArrow(_greedy, "key long, group long")
    nodes = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    state = _cut(nodes.join(pairs.select(F.col("b").alias("key")).distinct().withColumn("later", F.lit(True)), "key", "left").select("key", F.when(F.col("later"), None).otherwise(F.lit(True)).alias("kept")))
    while not state.where("kept IS NULL").isEmpty():
        told = pairs.join(state.select(F.col("key").alias("a"), "kept"), "a").groupBy(F.col("b").alias("key")).agg(
            F.max(F.coalesce("kept", F.lit(False))).alias("some"), F.max(F.col("kept").isNull()).alias("open")
        )
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("some"), False).when(~F.col("open"), True)
        state = _cut(state.join(told, "key", "left").select("key", new.alias("kept")))
    kept = state.where("kept").select(F.col("key").alias("a"))
    joined = pairs.join(kept, "a").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("group"))
    return state.join(joined, "key", "left").select("key", F.when(F.col("kept"), F.col("key")).otherwise(F.col("group")).alias("group"))


def fuzzy_matches(df: DataFrame, threshold: float = 92.0, place: float = 90.0) -> DataFrame:
    """key, group: what a greedy pass over the keys of df (first, name, place) in ascending order makes of them; keys that match none may be missing.

    Keys come in batches, each a few times as large as all before it. A batch is compared with the keys kept so far, and what matches none of
    them with itself, so pairs of keys that are both not kept are seldom looked at. Candidates come from two bounds on the ratio:

    * If the sorted tokens of both sides are near each other by insertions and deletions, so are their bags of
      characters. Keys of one place are packed into blocks, and blocks whose places are alike are compared in memory.
    * If the common tokens alone are near one side, or all of it, the tokens that the other lacks weigh little, so the
      other has one of this side's first rare tokens.
    """
    miss = 1 - threshold / 100
    named = _sorted_tokens(df.where("name <> ''"), "name")
    keys = blocks.kept(_rare_first(named, "tokens", "token").withColumn("first", F.col("first").cast("long")), "keys")
    places = blocks.kept(_places(keys, place), "alike")

    def matching(one: DataFrame, two: DataFrame | None = None) -> DataFrame:
        sides = one, one if two is None else two
        told = [side.select(F.col("first").alias(k), F.col("name").alias(f"n{k}"), F.col("place").alias(f"p{k}")) for k, side in zip(("a", "b"), sides, strict=True)]
        close = _by_tokens(one, miss, two).join(told[0], "a").join(told[1], "b").join(places, ["pa", "pb"], "left_semi").where(_ratio("na", "nb") >= threshold)
        return _by_bags(one, places, miss, threshold, two).unionAll(close.select("a", "b"))

    n, shares = keys.count(), []
    while n and FIRST * GROWTH ** len(shares) < n:
        shares.append(FIRST * GROWTH ** len(shares) / n)
    cuts = sorted(set(keys.agg(F.percentile_approx("first", shares)).first()[0])) if shares else []
    kept, groups = None, []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        batch = keys.where((F.lit(True) if lo is None else F.col("first") > lo) & (F.lit(True) if hi is None else F.col("first") <= hi))
        if kept is not None:
            joined = blocks.kept(matching(kept, batch).groupBy(F.col("b").alias("key")).agg(F.min("a").alias("group")), "joined")
            groups.append(joined)
            batch = blocks.kept(batch.join(joined, batch["first"] == joined["key"], "left_anti"), "rest")
        settled = blocks.kept(first_matches(matching(batch)), "settled")
        groups.append(settled)
        if hi is not None:
            more = batch.join(settled.where("key <> group"), batch["first"] == settled["key"], "left_anti")
            kept = blocks.kept(more if kept is None else kept.unionByName(more), "kept")
    return reduce(DataFrame.unionAll, groups)


def fuzzy_groups(df: DataFrame, threshold: float = 92.0, place: float = 90.0) -> DataFrame:
    """df's rows with `group`, the row_id of the first row that greedy matching in row_id order joins each to.

    Rows match when the token-set ratio of company and title reaches the threshold and their places are alike: equal,
    either empty, or of a token-set ratio of `place` or more. Every row is compared with every kept one that can match.
    Rows without company and title match nothing. The place compared is that of the group's first row.
    """
    slim = _cut(df.select("row_id", T.simple_key(F.concat_ws(" ", "company", "title")).alias("name"), T.simple_key(F.col("location")).alias("place")))
    # equal names and places are one: the greedy pass then runs over distinct keys
    keys = _cut(slim.groupBy("name", "place").agg(F.min("row_id").alias("first")))
    groups = fuzzy_matches(keys, threshold, place)
    found = keys.join(groups, keys["first"] == groups["key"], "left").select("name", "place", F.coalesce("group", "first").alias("group"))
    return slim.join(found, ["name", "place"]).select("row_id", F.when(F.col("name") == "", F.col("row_id")).otherwise(F.col("group")).alias("group"))


def fuzzy_best(df: DataFrame, **limits: float) -> DataFrame:
    """The best row of each fuzzy group."""
    return keep_first(df.join(fuzzy_groups(df, **limits), "row_id"), ["group"], _best_of(df))
