"""Deduplication, merging, ranking and selection over tables (D, J, W, T)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkstream.functions import text
from inkstream.session import materialise, partitions

_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"


def _with(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``found``, which has one row a key; null is a key like others."""
    other = found.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return df.join(other, same, "left").drop(*[f"__key_{k}" for k in keys])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key, the first in this order. Tasks keep one row of a key before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__row")).select("__row.*")


def folded(df: DataFrame, keys: list[str], order: list[str], filled: list[str]) -> DataFrame:
    """Of rows with one key, the first in this order, its empty ``filled`` columns taking the first later value: what
    ``upsert`` makes of rows that come one after the other. Rows of one place go by their values."""
    rest = [c for c in df.columns if c not in [*keys, *order]]
    place = F.struct(*order, *rest)
    fills = [F.min(F.when(F.col(c) != "", F.struct(*order, c)))[c].alias(f"__{c}") for c in filled]
    found = df.groupBy(*keys).agg(F.min_by(F.struct("*"), place).alias("__row"), *fills)
    return found.select(*[F.coalesce(f"__{c}", F.col("__row")[c]).alias(c) if c in filled else F.col("__row")[c].alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], priority: str, pos: str) -> DataFrame:
    """Of rows with one key, the one of highest priority, at the position where the key first stood."""
    best = F.max_by(F.struct("*"), F.struct(priority, pos)).alias("__row")
    found = df.groupBy(*keys).agg(best, F.min(pos).alias("__first"))
    return found.select(*[F.col("__first").alias(c) if c == pos else F.col("__row")[c].alias(c) for c in df.columns])


def newest_wins(df: DataFrame, keys: list[str], date: str, pos: str) -> DataFrame:
    """The newest row of each key, a tie going to the earlier row; it takes the key's first position."""
    age = -F.unix_micros(F.coalesce(F.col(date), F.expr(_EPOCH)))
    found = df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(age, pos)).alias("__row"), F.min(pos).alias("first_pos"))
    return found.select("__row.*", "first_pos")


def upsert(known: DataFrame, new: DataFrame, key: str, filled: list[str]) -> DataFrame:
    """New keys are added; of known ones, empty ``filled`` columns take the new value.

    Adds ``action`` (added, updated, kept). ``new`` may repeat a key: its first row in column ``pos`` counts.
    """
    new, known = first_wins(new, [key], ["pos"]), known.drop("action")
    k, n = known.alias("k"), new.alias("n")
    joined = k.join(n, F.col(f"k.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.col(f"k.{key}").isNull()
    columns, changed = [], F.lit(False)
    for c in known.columns:
        old, fresh = F.col(f"k.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in filled:
            empty = F.coalesce(old, F.lit("")) == ""
            changed = changed | (empty & (F.coalesce(fresh, F.lit("")) != ""))
            columns.append(F.when(is_new | empty, F.coalesce(F.nullif(fresh, F.lit("")), old)).otherwise(old).alias(c))
        else:
            columns.append(F.when(is_new, fresh).otherwise(old).alias(c))
    return joined.select(*columns, F.when(is_new, "added").when(changed, "updated").otherwise("kept").alias("action"))


def unknown(new: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys, one by one, the other table has not."""
    for key in keys:
        new = new.join(known.select(key).distinct(), key, "left_anti")
    return new


def repeats(df: DataFrame, keys: list[str], pos: str, name: str = "dup") -> DataFrame:
    """Adds whether an earlier row has the same keys. The first positions are joined back: a frequent key is one row on
    their side, and its rows may be split on the other."""
    first = df.groupBy(*keys).agg(F.min(pos).alias("__first"))
    return _with(df, first, keys).withColumn(name, F.col("__first") < F.col(pos)).drop("__first")


def duplicate_of(df: DataFrame, keys: list[str], title: str, url: str, pos: str) -> DataFrame:
    """Adds the url of the first row with this title."""
    by = [*keys, title]
    return _with(df, df.groupBy(*by).agg(F.min_by(url, pos).alias("duplicate_of")), by)


def merge_week(selected: DataFrame, known: DataFrame, week: DataFrame, pos: str = "pos") -> DataFrame:
    """Selected articles that the global table has neither by url nor by title (J15: over 0.8 of the words alike, which
    equal normalised titles are), merged into the week's table by url: new ones are added, empty snippets filled.

    Tables have url, title, snippet, and the selected ones a position. Result: the week's rows with ``action``.
    """
    fresh = selected.join(known.select("url").distinct(), "url", "left_anti").withColumn("__norm", text.title_plain("title"))
    titles = known.groupBy(text.title_plain("title").alias("__norm")).agg(F.max("title").alias("__title"))
    fresh = fresh.join(titles, "__norm", "left").where(F.col("__title").isNull() | ~F.coalesce(jaccard(F.col("title"), F.col("__title")) > 0.8, F.lit(False)))
    return upsert(week, fresh.drop("__norm", "__title"), "url", ["snippet"])


def cached(df: DataFrame, cache: DataFrame, keys: list[str], versions: dict[str, str]) -> DataFrame:
    """Rows with the cached columns, and ``hit`` (true where all version columns are the wanted ones; else they are
    null). ``cache`` has one row a key."""
    found = df.join(cache, keys, "left")
    hit = F.lit(True)
    for column, wanted in versions.items():
        hit = hit & F.coalesce(F.col(column) == wanted, F.lit(False))
    rest = [c for c in cache.columns if c not in keys and c not in versions]
    return found.select(*df.columns, hit.alias("hit"), *[F.when(hit, F.col(c)).alias(c) for c in rest])


def anchor_picks(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's three visual anchors, in order: the first of each type, then others with descriptions of their own.

    Columns: keys, pos (articles in order), anchors (array of type and description). Types that no article has get a
    default. A group's anchors are as many as there are fixed ones at most, since equal ones count once.
    """
    # What stands in for a missing type.
    defaults = [("person", "professional"), ("place", "modern retail environment"), ("object", "technology device")]
    each = anchors.select(*keys, "pos", F.posexplode_outer("anchors").alias("i", "a"))
    once = each.groupBy(*keys, "a").agg(F.min(F.struct("pos", "i")).alias("at"))
    ordered = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("at", "a")))).alias("own"))
    own = F.transform("own", lambda x: x["a"])
    pair = lambda t, d: F.struct(F.lit(t).alias("type"), F.lit(d).alias("description"))
    spare = F.filter(F.array(*[pair(t, d) for t, d in defaults]), lambda d: ~F.exists("own", lambda x: x["type"] == d["type"]))
    same = lambda acc, x, field: F.exists(acc, lambda y: y[field] == x[field])
    add = lambda acc, x, also: F.when((F.size(acc) < 3) & ~same(acc, x, "description") & also, F.array_append(acc, x)).otherwise(acc)
    none = F.array().cast("array<struct<type: string, description: string>>")
    rows = ordered.select(*keys, own.alias("own")).select(*keys, F.concat("own", spare).alias("all"))
    rows = rows.withColumn("first", F.aggregate("all", none, lambda acc, x: add(acc, x, ~same(acc, x, "type"))))
    rows = rows.withColumn("three", F.aggregate("all", F.col("first"), lambda acc, x: add(acc, x, F.lit(True))))
    return rows.select(*keys, F.posexplode("three").alias("place", "x")).select(*keys, (F.col("place") + 1).alias("place"), "x.type", "x.description")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def diverse_top(df: DataFrame, keys: list[str], source: str, order: str, n: int = 7, most: int = 3, pool: int | None = 100) -> DataFrame:
    """The first n in this order, with at most ``most`` of one source, unless too few others are left.

    Closed form of the greedy walk: rows within their source's cap come first; if a group has fewer than n of them, the
    last of its other rows fill up. So a source gives its first ``most`` rows and its last n, and windows run over keys and
    source. ``pool`` cuts each group before.
    """
    if pool:
        df = top_k(df, keys, [order], pool, "__pos").drop("__pos")
    sizes = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("__size"))
    short = sizes.groupBy(*keys).agg((F.lit(n) - F.sum(F.least("__size", F.lit(most)))).alias("__short")).where("__short > 0")
    first = top_k(df, [*keys, source], [order], most, "__rn").drop("__rn")
    last = top_k(df, [*keys, source], [F.desc(order)], n, "__back").join(sizes, [*keys, source]).where(F.col("__size") - F.col("__back") >= most).join(short, keys)
    fill = top_k(last, keys, [F.desc(order)], n, "__back").where("__back <= __short").select(df.columns)
    return top_k(first.unionByName(fill), keys, [order], n)


def capped_top(df: DataFrame, keys: list[str], domain: str, rank: str, n: int, cap: int = 2, relaxed: int = 3) -> DataFrame:
    """W05 without near-duplicates: by rank, ``cap`` of a domain; if short, up to ``relaxed``."""
    df = df.withColumn("__d", F.row_number().over(Window.partitionBy(*keys, domain).orderBy(rank))).where(F.col("__d") <= relaxed)
    return top_k(df.withColumn("__late", F.col("__d") > cap), keys, ["__late", rank], n, "place").drop("__d", "__late")


def similar_titles(a: str, b: str) -> bool:
    """Equal, or over 0.8 of the words shared; the first title's repeated words count each."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    other = set(y)
    return sum(w in other for w in x) / max(len(x), len(y)) > 0.8


def select_ranked(df: DataFrame, key: str, n: int, most_paywalled: int = 1, keep_best: bool = True) -> DataFrame:
    """Constrained selection, a group of ranked rows at a time (the ranking keeps groups to a fixed size).

    Columns: url, bare_title, domain, rank, hard, sponsored, paywalled. ``keep_best`` keeps the best-ranked paywalled
    row; False keeps the worst-ranked one. Result: url, place, and the first pass's verdict for every row.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["rank", "url"]).to_dict("records")
        taken: list[dict] = []
        titles: list[str] = []
        used: dict[str, int] = {}
        verdict: dict[str, str] = {}
        cap = 2
        for cap in (2, 3):
            for r in rows:
                if len(taken) >= n:
                    break
                if r["url"] in {t["url"] for t in taken}:
                    continue
                if r["hard"]:
                    why = "hardControversy"
                elif r["sponsored"]:
                    why = "sponsored"
                elif any(similar_titles(r["bare_title"], t) for t in titles):
                    why = "duplicate"
                elif used.get(r["domain"], 0) >= cap:
                    why = "domainCap"
                else:
                    why = "selected"
                    taken.append(r)
                    titles.append(r["bare_title"])
                    used[r["domain"]] = used.get(r["domain"], 0) + 1
                if cap == 2:
                    verdict[r["url"]] = why
            if len(taken) >= n:
                break
        walled = sorted((t for t in taken if t["paywalled"]), key=lambda t: t["rank"] if keep_best else -t["rank"])
        excess = walled[most_paywalled:]
        if excess:
            gone = {t["url"] for t in excess}
            taken = [t for t in taken if t["url"] not in gone]
            here = {t["url"] for t in taken}
            spare = [r for r in rows if not (r["paywalled"] or r["hard"] or r["sponsored"] or r["url"] in here)]
            for r in spare[: len(excess)]:
                if len(taken) < n and used.get(r["domain"], 0) < cap and not any(similar_titles(r["bare_title"], t) for t in titles):
                    taken.append(r)
                    titles.append(r["bare_title"])
                    used[r["domain"]] = used.get(r["domain"], 0) + 1
        place = {t["url"]: i + 1 for i, t in enumerate(taken)}
        urls = [r["url"] for r in rows]
        return pd.DataFrame({key: group[key].iloc[0], "url": urls, "place": pd.array([place.get(u) for u in urls], "Int64"), "verdict": [verdict.get(u, "not_reached") for u in urls], "relaxed": len(taken) < n or cap == 3})

    kind = df.schema[key].dataType.simpleString()
    columns = [key, "url", "bare_title", "domain", "rank", "hard", "sponsored", "paywalled"]
    return df.select(*columns).groupBy(key).applyInPandas(pick, f"{key} {kind}, url string, place long, verdict string, relaxed boolean")


def reranked(df: DataFrame, ranks: DataFrame, key: str, fallback: DataFrame, n: int = 7) -> DataFrame:
    """A group's rows by a valid list of ranks, else the fallback's."""
    from inkstream.operators.gates import ranking_valid

    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"))
    numbered = ranks.join(sizes, key)
    good = ranking_valid(numbered, [key], n).where("valid").select(key)
    by_rank = ranks.join(good, key, "left_semi").select(key, "url", "rank", F.lit("ranked").alias("origin"))
    rest = fallback.join(good, key, "left_anti").select(key, "url", "rank", F.lit("fallback").alias("origin"))
    return by_rank.unionByName(rest)


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct words of two titles."""
    x, y = (F.array_distinct(text.words(text.title_plain(t))) for t in (a, b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def title_classes(df: DataFrame, key: str, id_: str, title: str) -> DataFrame:
    """One row for each title of a group: the least id stands for it; and how many rows have it."""
    return df.groupBy(key, title).agg(F.min(id_).alias(id_), F.count(F.lit(1)).alias("members"))


def title_members(df: DataFrame, key: str, id_: str, title: str) -> DataFrame:
    """Which representative of ``title_classes`` stands for each row: key, id and ``stands_for``. A frequent title is one row
    on the joined side, and its rows may be split on the other."""
    rows = df.select(key, id_, title)
    return _with(rows, rows.groupBy(key, title).agg(F.min(id_).alias("stands_for")), [key, title]).drop(title)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each title, a row a distinct word code, with how often it stands there."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        found = [np.unique(np.array(c, np.int64), return_counts=True) for c in codes]
        at = pa.array(np.repeat(np.arange(len(codes)), [len(f[0]) for f in found]))
        word, weight = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("key", "id", "n")), pa.array(word), pa.array(weight.astype(np.int32))], names=["key", "id", "n", "word", "weight"])


def _size_class(n: Column) -> Column:
    """Classes of sizes (from 1 up) that grow by a quarter each; ascending with the size."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")


#: Marks of a title (bits of two numbers), and how many of them are told with their words' weight.
MARKS, HEAVY = 128, 12


def _marks(words: Column, high: bool) -> Column:
    """The lower or upper 64 of a title's ``MARKS``: each of its words sets the one that its code's low bits tell."""
    mine = F.filter(words, lambda x: (x.bitwiseAND(F.lit(64)) != 0) == high)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def _weighed(codes: list[int], weights: list[int]) -> tuple[list[int], int, int]:
    """The heaviest marks of a title (weight and mark in one number), and the bits of its others."""
    sums = np.bincount(np.array(codes, np.int64) & (MARKS - 1), weights, MARKS).astype(np.int64)
    top = np.argsort(-sums, kind="stable")[:HEAVY]
    top = top[sums[top] > 0]
    rest = sums > 0
    rest[top] = False
    return (np.minimum(sums[top], 1 << 23) << 7 | top).tolist(), *np.packbits(rest, bitorder="little").view("<i8").tolist()


def _lacking(a: str, b: str) -> Column:
    """How much of the first title's weight stands at marks that the second has not, at least."""
    low, high = F.col(f"{b}.low"), F.col(f"{b}.high")
    bit = lambda x: F.call_function("shiftright", F.when(x.bitwiseAND(F.lit(64)) == 0, low).otherwise(high), x.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long"))
    heavy = F.aggregate(F.col(f"{a}.heavy"), F.lit(0), lambda acc, x: acc + F.when(bit(x) == 0, F.shiftright(x, 7)).otherwise(F.lit(0)))
    return heavy + sum(F.bit_count(F.col(f"{a}.{r}").bitwiseAND(F.bitwise_not(m))) for r, m in (("low", low), ("high", high)))


def _probes(least: float):
    """Of each title (words by rarity, with weights), the words by which it may meet another as the first title."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, words, needs, lefts, marks = [], [], [], [], []
            for i, (n, codes, weights) in enumerate(zip(batch.column("n").to_pylist(), batch.column("words").to_pylist(), batch.column("weights").to_pylist(), strict=True)):
                bar, left, after = least * n - 1e-6, n, Counter(weights)
                sizes, mine = sorted(after, reverse=True), _weighed(codes, weights)
                for code, weight in zip(codes, weights, strict=True):
                    if left <= bar:
                        break
                    after[weight] -= 1
                    got, kinds = weight, 1
                    for size in sizes:  # the heaviest words behind this one, until they reach the bar together
                        if got > bar:
                            break
                        more = min(after[size], max(0, math.floor((bar - got) / size) + 1))
                        got, kinds = got + more * size, kinds + more
                    if got > bar:
                        took.append(i)
                        marks.append(mine)
                        words.append(code)
                        needs.append(kinds)
                        lefts.append(left)
                    left -= weight
            at = [pa.array([m[k] for m in marks], t) for k, t in enumerate((pa.list_(pa.int32()), pa.int64(), pa.int64()))]
            own = (batch.column(c).take(pa.array(took, pa.int64())) for c in ("key", "id", "n"))
            yield pa.RecordBatch.from_arrays([*own, *at, pa.array(words, pa.int64()), pa.array(needs, pa.int32()), pa.array(lefts, pa.int32())], names=["key", "id", "n", "heavy", "low", "high", "word", "needs", "left"])

    return rows


def title_candidates(df: DataFrame, key: str, id_: str, title: str, least: float = 0.8) -> DataFrame:
    """Pairs (key, a, b) that may share over ``least`` of their words: a weighted prefix filter for multisets.

    A title's words stand by rarity in their group, each weighted by how often the title has it. The rarest word that two
    titles share is such that the first title's words from there on weigh over least * n, n being either's length: only
    the first words of its rarity order, a fifth of its weight, are looked up. From there the second title must have as
    many kinds left as the first needs, heaviest first, to reach that weight; and it has fewer left than its length, which
    is below n / least. Kinds left fall into classes that grow by a quarter; the join is on word and class, so a frequent
    word, behind which no title has many kinds left, meets few. Titles bring marks of their words along, the first one with the
    weights of its heaviest: what stands at marks that the second lacks is not shared, so most pairs that fail leave the join
    never.
    """
    rows = df.select(F.col(key).alias("key"), F.col(id_).alias("id"), text.words(F.col(title)).alias("w"))
    rows = rows.select("key", "id", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("codes")).where("n > 0")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = f"key {kinds['key']}, id {kinds['id']}, n int"
    each = rows.mapInArrow(_counted, f"{head}, word long, weight int")
    seen = each.groupBy("key", "word").agg(F.count(F.lit(1)).alias("df"))
    each = _with(each, seen, ["key", "word"])
    dealt = each.repartition(partitions(df.sparkSession), "key", "id")  # by number: the work is not in the bytes
    titles = dealt.groupBy("key", "id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word", "weight"))).alias("x"))
    titles = materialise(titles.select("key", "id", "n", F.col("x.word").alias("words"), F.col("x.weight").alias("weights"), _marks(F.col("x.word"), False).alias("low"), _marks(F.col("x.word"), True).alias("high")), "titles")
    first = titles.mapInArrow(_probes(least), f"{head}, heavy array<int>, low long, high long, word long, needs int, left int")
    most = F.ceil(F.col("n") / least).cast("int")
    first = first.withColumn("class", F.explode(F.sequence(_size_class(F.col("needs")), _size_class(F.greatest(most, "needs")))))
    second = titles.select("key", "id", "n", "low", "high", F.size("words").alias("k"), F.posexplode("words").alias("place", "word")).withColumn("kinds", F.col("k") - F.col("place"))
    second = second.withColumn("class", _size_class(F.col("kinds")))
    a, b = first.alias("a"), second.alias("b")
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.class") == F.col("b.class"))
    fits = (F.col("a.id") < F.col("b.id")) & (F.col("kinds") >= F.col("needs")) & (F.col("left") > F.col("b.n") * least - 1e-6)
    fits = fits & (F.col("a.n") - _lacking("a", "b") > F.greatest("a.n", "b.n") * least - 1e-6)
    return a.join(b, same & fits).select(F.col("a.key").alias(key), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


#: Titles of one leader in a block, and pairs in a bucket of block pairs, about.
TITLES, PAIRS = 256, 16384


def _met_in_blocks(pairs: DataFrame, ids: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) with a ``bucket`` each; and rows (part, id), the same buckets, each title once in a bucket, however many of its pairs
    meet there.

    A title's leader is its first partner by id, or itself: copies of one text have few leaders. A leader's titles are
    dealt to blocks, pairs of blocks to buckets. So a group of n copies, which has n * n / 2 pairs, sends each title to
    about n / ``TITLES`` buckets.
    """
    first = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    members = first.union(pairs.select("a", "a")).groupBy("id").agg(F.min("leader").alias("leader"))
    members = materialise(members, "leaders")
    parts = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / TITLES).alias("parts")).where("parts > 1")
    blocks = members.join(parts, "leader", "left").select("id", F.xxhash64("leader", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).alias("block"))
    buckets = max(partitions(pairs.sparkSession), math.ceil(pairs.count() / PAIRS))
    for side in ("a", "b"):
        pairs = pairs.join(blocks.select(F.col("id").alias(side), F.col("block").alias(f"block_{side}")), side)
    placed = materialise(pairs.withColumn("bucket", F.pmod(F.xxhash64("block_a", "block_b"), F.lit(buckets)).cast("int")).drop("block_a", "block_b"), "placed")
    return placed, placed.select(F.col("bucket").alias("part"), F.col("a").alias(ids)).union(placed.select("bucket", "b")).distinct()


def near_titles(df: DataFrame, key: str, id_: str, title: str, least: float = 0.8) -> DataFrame:
    """J14 as a join: pairs of one group that share over ``least`` of their words. Rows with equal titles should be one row
    each (``title_classes``), so that ids are distinct.

    The overlap counts the first title's repeated words each. ``title_candidates`` finds the pairs; their titles meet in
    blocks, where each stands once for many pairs, and are compared in time that grows with their number of words.
    """
    dealt = df.select(F.col(id_).alias("__id"), F.concat_ws(" ", text.words(F.col(title))).alias("__words"), F.col(key).alias("__key"))
    given = materialise(dealt.repartition(partitions(df.sparkSession), "__id"), "given-titles")  # by number: the work is not in the bytes
    pairs = materialise(title_candidates(given, "__key", "__id", "__words", least), "candidates")
    placed, wanted = _met_in_blocks(pairs, "__id")
    titles = wanted.join(given.select("__id", "__words"), "__id").select("part", "__id", "__words")

    def compare(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        words = {i: w.split(" ") for i, w in zip(right.column("__id").to_pylist(), right.column("__words").to_pylist(), strict=True)}
        kinds = {i: set(w) for i, w in words.items()}
        overlap = [sum(w in kinds[b] for w in words[a]) / max(len(words[a]), len(words[b])) for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)]
        out = left.select(["__key", "a", "b"]).append_column("overlap", pa.array(overlap, pa.float64()))
        return out.filter(pa.array([x > least for x in overlap], pa.bool_()))

    schema = StructType([placed.schema[c] for c in ("__key", "a", "b")] + [StructField("overlap", DoubleType())])
    return placed.groupBy("bucket").cogroup(titles.groupBy("part")).applyInArrow(compare, schema).toDF(key, "a", "b", "overlap")
