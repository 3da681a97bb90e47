"""Category codes, counts and target encodings, as fit tables and joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.operators.aggregates import one_row
from cartloom.operators.featuremaps import SMALL_MAP
from cartloom.operators.joins import attach, attach_frequent, outer_counts
from cartloom.operators.ordered import HOT_ROWS, Shift, hot_groups, number_rows, ordered_windows, small_map
from cartloom.runtime import cut_lineage, plan_bytes, stored


# --- vocabularies -----------------------------------------------------------

def vocabulary(df: DataFrame, columns: str | Sequence[str], start: int = 0, min_count: int = 1) -> DataFrame:
    """Distinct non-null values of one or more columns, coded in sorted order."""
    names = [columns] if isinstance(columns, str) else list(columns)
    if len(names) == 1:
        values = df.select(F.col(names[0]).alias("value"))
    else:
        values = df.select(F.explode(F.array(*names)).alias("value"))
    counts = values.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if min_count > 1:
        counts = counts.filter(F.col("n") >= min_count)
    return stored(number_rows(counts, ["value"], "code", start), df)


def vocabulary_by_first(df: DataFrame, column: str, order: Sequence, start: int = 0) -> DataFrame:
    """Distinct values coded by first appearance in the given order."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.min(F.struct(*order)).alias("_at"))
    return stored(number_rows(firsts, ["_at", "value"], "code", start).select("value", "code"), df)


def vocabulary_by_count(df: DataFrame, columns: Sequence[str], start: int = 0) -> DataFrame:
    """Shared codes over several columns, the most frequent value first."""
    values = df.select(F.explode(F.array(*columns)).alias("value")).filter("value is not null")
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return stored(number_rows(counts, [F.desc("n"), "value"], "code", start), df)


def encode(df: DataFrame, vocab: DataFrame, column: str, out: str, default: int | None = None, skewed: bool = False) -> DataFrame:
    """Codes from a vocabulary; unseen and null values get the default.

    ``skewed`` says that few values make most rows: by the vocabulary's counts ``n``
    only rows of the others are moved, and the rows are made twice.
    """
    table = vocab.select("value", F.col("code").alias(out), *(["n"] if skewed else []))
    coded = attach_frequent(df, table, {column: "value"}, "n", SMALL_MAP) if skewed else attach(df, table, {column: "value"})
    return coded if default is None else coded.withColumn(out, F.coalesce(out, F.lit(default)))


def decode(df: DataFrame, vocab: DataFrame, column: str, out: str) -> DataFrame:
    return attach(df, vocab.select("code", F.col("value").alias(out)), {column: "code"})


def extend_vocabulary(vocab: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Append unseen values of another source behind the highest code."""
    fresh = values.select(F.col(column).alias("value")).filter("value is not null").distinct()
    fresh = fresh.join(vocab, "value", "left_anti")
    highest = vocab.select(F.coalesce(F.max("code"), F.lit(-1))).scalar()
    added = number_rows(fresh, ["value"], "code").withColumn("code", F.col("code") + highest + 1)
    return vocab.select("value", "code").unionByName(added)


def encode_lists(df: DataFrame, keys: Sequence[str], column: str, vocab: DataFrame, out: str,
                 default: int = 0) -> DataFrame:
    """Codes for the elements of a list column, order kept.

    Distinct lists are not assumed: elements are exploded, joined and put back
    by position. The input lists bound what is collected.
    """
    items = df.select(*keys, F.posexplode_outer(column).alias("_at", "_item"))
    coded = encode(items, vocab, "_item", "_code", default)
    pair = F.when(F.col("_at").isNotNull(), F.struct("_at", "_code"))
    packed = coded.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    lists = packed.select(*keys, F.col("_pairs._code").alias(out))
    return df.join(lists, list(keys), "left")


def collapse_rare(df: DataFrame, column: str, most: int, other, out: str,
                  also: Sequence[str] = ()) -> DataFrame:
    """Values seen at most ``most`` times become ``other``, in listed columns too."""
    rare = stored(df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most), df)
    for source, target in [(column, out), *[(c, f"{c}_{out}") for c in also]]:
        hits = rare.select(F.col("_v").alias(f"_v_{target}"), F.lit(1).alias("_hit"))
        df = df.join(hits, df[source] == hits[f"_v_{target}"], "left")
        df = df.withColumn(target, F.when(F.col("_hit") == 1, other).otherwise(F.col(source)))
        df = df.drop("_hit", f"_v_{target}")
    return df


def cap_list_frequency(df: DataFrame, keys: Sequence[str], column: str, least: int, rare_code: int = 1,
                       out: str = "capped") -> DataFrame:
    """Rare elements of a list become ``rare_code``; flags 2 frequent, 1 rare."""
    items = df.select(*keys, F.posexplode(column).alias("_at", "_item"))
    counts = stored(items.groupBy("_item").agg(F.count(F.lit(1)).alias("_n")), df)
    marked = attach(items, counts, ["_item"]).withColumn("_frequent", F.col("_n") >= least)
    pair = F.struct(
        "_at",
        F.when(F.col("_frequent"), F.col("_item")).otherwise(rare_code).alias("item"),
        F.when(F.col("_frequent"), 2).otherwise(1).alias("flag"),
    )
    packed = marked.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("_p"))
    lists = packed.select(*keys, F.col("_p.item").alias(out), F.col("_p.flag").alias(f"{out}_flags"))
    return df.join(lists, list(keys), "left")


def supported_ids(left: DataFrame, right: DataFrame, key: str, condition: Column, start: int = 1) -> DataFrame:
    """Embedding ids for keys whose joint counts meet the condition."""
    return number_rows(outer_counts(left, right, key).filter(condition), [key], "code", start)


def cardinalities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Table size needed per code column: highest code + 1."""
    row = df.agg(*[(F.max(c).cast("long") + 1).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("cardinality")) for c in columns]
    return row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def multi_hot(df: DataFrame, column: str, sep: str, values: Sequence[str], prefix: str = "is_") -> DataFrame:
    """0/1 columns for exact tokens of a delimited list."""
    tokens = F.split(column, sep)
    has = lambda v: F.coalesce(F.array_contains(tokens, v).cast("int"), F.lit(0))
    return df.withColumns({prefix + v: has(v) for v in values})


# --- token frequencies ------------------------------------------------------

def frequent_token(df: DataFrame, keys: Sequence[str], column: str, sep: str, out: str) -> DataFrame:
    """The token of each row that is most frequent overall; '' for none.

    Ties go to the token that comes first in the row.
    """
    present = df.filter(F.col(column).isNotNull())
    counts = present.select(F.explode(F.split(column, sep)).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(counts, df)
    # Distinct tokens keep the order of their first place in the row.
    spots = present.select(*keys, F.posexplode(F.array_distinct(F.split(column, sep))).alias("_at", "_t"))
    best = attach(spots, counts, ["_t"]).groupBy(*keys).agg(
        F.max_by("_t", F.struct("_n", -F.col("_at"))).alias(out))
    return df.join(best, list(keys), "left").fillna("", [out])


def word_counts(texts: DataFrame, column: str, sep: str = " ") -> DataFrame:
    """Occurrences of each word over distinct texts.

    Copies merge map-side before the texts travel, and the words aggregate
    map-side again before they do.
    """
    words = texts.select(column).distinct().select(F.explode(F.split(column, sep)).alias("word"))
    return stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), texts)


def words_by_frequency(df: DataFrame, keys: Sequence[str], column: str, counts: DataFrame, above: int = 2,
                       below: int = 100000, skip: Sequence[str] = ("", "[", "]", ".", "!", "@", "_", "#"),
                       sep: str = " ") -> DataFrame:
    """Each row's words of middling frequency, the rarest first, as a list."""
    kept = counts.filter((F.col("n") > above) & (F.col("n") < below) & ~F.col("word").isin(*skip))
    items = df.select(*keys, F.posexplode(F.split(column, sep)).alias("_at", "word"))
    ranked = items.join(kept, "word").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("n", "_at", "word"))).alias("_w"))
    return ranked.select(*keys, F.col("_w.word").alias("words"))


# --- counts -----------------------------------------------------------------

def pair_counts(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Count of (keys, item) and its share of the keys' rows."""
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(totals, list(keys)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def count_encode(df: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], out: str) -> DataFrame:
    """Occurrences of the key over this and all other tables."""
    stacked = df.select(*keys)
    for other in others:
        stacked = stacked.unionByName(other.select(*keys))
    return attach(df, stored(stacked.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), stacked), keys)


def frequency_encode(df: DataFrame, split: str, keys: Sequence[str], out: str) -> DataFrame:
    """Share of the key among the rows of its own split."""
    counts = df.groupBy(split, *keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = small_map(df.groupBy(split).agg(F.count(F.lit(1)).alias("_t")), split, F.col("_t"))
    shares = counts.withColumn(out, F.col("_n") / F.try_element_at(sizes, F.col(split))).drop("_n")
    return attach(df, stored(shares, df), [split, *keys])


def count_maps(df: DataFrame, key_sets: Sequence[Sequence[str]]) -> dict[tuple[str, ...], DataFrame]:
    """One count table per key set, all counted from one stored copy of the keys."""
    df = stored(df.select(*dict.fromkeys(c for k in key_sets for c in k)), df)
    count = lambda k: df.groupBy(*k).agg(F.count(F.lit(1)).alias("cnt_" + "_".join(k)))
    return {tuple(k): stored(count(k), df) for k in key_sets}


def attach_counts(df: DataFrame, maps: dict[tuple[str, ...], DataFrame], missing: int = 1, small: int = SMALL_MAP,
                  hot_rows: int | None = None) -> DataFrame:
    """The rows with every map's count of their keys, ``missing`` where it has none.

    Maps of up to ``small`` bytes are left to Spark's broadcast; of larger ones only
    lines of another count than ``missing`` are looked up. Those still larger that
    share a column take one shuffle of the rows, by that column, for all of them if
    the session's ``runtime.SHARED_SHUFFLES`` is "false", and one for each otherwise.
    Rows of its hot values (told from a sample, as in ``ordered_windows``) are
    joined map by map, where Spark splits them.
    """
    names = {keys: "cnt_" + "_".join(keys) for keys in maps}
    few, large = {}, {}
    for keys, table in maps.items():
        if plan_bytes(table) > small:
            table = stored(table.filter(F.col(names[keys]) != missing))
        (large if plan_bytes(table) > small else few)[keys] = table
    one = lambda rows, keys, table: attach(rows, table, keys, {names[keys]: missing})
    meeting = _meeting_columns(list(large))
    hot = {c: cut_lineage(hot_groups(df, [c], HOT_ROWS if hot_rows is None else hot_rows)) for c, sets in meeting.items() if len(sets) > 1}
    hot = {c: table for c, table in hot.items() if not table.isEmpty()}
    whole, aside = df, None
    if hot:
        for c, table in hot.items():
            marks = table.select(F.col(c).alias(f"_v_{c}"), F.lit(True).alias(f"_hot_{c}"))
            whole = whole.join(F.broadcast(marks), F.col(c).eqNullSafe(F.col(f"_v_{c}")), "left")
        is_hot = F.coalesce(*[F.col(f"_hot_{c}") for c in hot], F.lit(False))
        whole, aside = whole.filter(~is_hot).select(*df.columns), whole.filter(is_hot).select(*df.columns)
        for keys, table in large.items():
            aside = one(aside, keys, table)
    for c, sets in meeting.items():
        if len(sets) == 1:
            whole = one(whole, sets[0], large[sets[0]])
            continue
        whole = whole.repartition(c)
        for keys in sets:
            whole = one(whole, keys, large[keys].repartition(c))
    whole = whole if aside is None else whole.unionByName(aside)
    for keys, table in few.items():
        whole = one(whole, keys, table)
    return whole.select(*df.columns, *names.values())


def _meeting_columns(key_sets: Sequence[Sequence[str]]) -> dict[str, list[Sequence[str]]]:
    """The key sets under a column that each has, under as few columns as taking the most shared one first gives."""
    left, out = list(key_sets), {}
    while left:
        shared = Counter(c for k in left for c in k).most_common(1)[0][0]
        out[shared] = [k for k in left if shared in k]
        left = [k for k in left if shared not in k]
    return out


def positive_pairs(df: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """Pairs with any positive label: per-label sums and row count."""
    hit = F.greatest(*[F.col(x) for x in labels]) > 0
    return df.filter(hit).groupBy(a, b).agg(*[F.sum(x).alias(f"{x}_sum") for x in labels], F.count(F.lit(1)).alias("n"))


def difference(df: DataFrame, entity: Sequence[str], order: Sequence, column: str, step: int, out: str,
               hot_rows: int | None = None) -> DataFrame:
    """Value minus the entity's previous (next when negative) value; 0 at the end."""
    return differences(df, entity, order, column, {out: step}, hot_rows)


def differences(df: DataFrame, entity: Sequence[str], order: Sequence, column: str, steps: dict[str, int],
                hot_rows: int | None = None) -> DataFrame:
    """Differences by several steps, one column each, in one pass over the ordered rows."""
    moved = ordered_windows(df, entity, order, {f"_at_{out}": Shift(column, step) for out, step in steps.items()}, hot_rows)
    made = {out: F.coalesce(F.col(column) - F.col(f"_at_{out}"), F.lit(0)) for out in steps}
    return moved.withColumns(made).drop(*[f"_at_{out}" for out in steps])


# --- target encoding --------------------------------------------------------

def fit_target(df: DataFrame, keys: Sequence[str], labels: Sequence[str], min_count: int = 0) -> DataFrame:
    """Mergeable encoder table: sum per label and one count per key."""
    table = df.groupBy(*keys).agg(*[F.sum(y).alias(f"{y}_sum") for y in labels], F.count(F.lit(1)).alias("te_count"))
    return stored(table.filter(F.col("te_count") > min_count) if min_count else table, df)


def merge_target(tables: Sequence[DataFrame], keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One encoder table out of several, e.g. of different days."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    return stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*(f"{y}_sum" for y in labels), "te_count"]])


def smoothed(total: Column, count: Column, prior: Column | float, weight: float) -> Column:
    prior = F.lit(prior) if isinstance(prior, (int, float)) else prior
    return F.try_divide(total + prior * weight, count + weight)


def apply_target(df: DataFrame, table: DataFrame, on: Sequence[str] | dict[str, str], priors: dict[str, float],
                 weight: float, out: str, in_train: Column | None = None, least_support: dict[str, int] | None = None,
                 digits: int | None = None) -> DataFrame:
    """Encoded columns ``<out>_<label>`` from a sums-and-count table.

    With ``in_train`` the row's own label leaves the sum (leave-one-out).
    ``least_support`` falls back to the prior at or below a count.
    """
    joined = attach(df, table, on)
    made = {}
    for y, prior in priors.items():
        total, count = F.col(f"{y}_sum"), F.col("te_count")
        if in_train is not None:
            flag = in_train.cast("int")
            total, count = total - F.col(y) * flag, count - flag
        value = smoothed(total, count, prior, weight)
        if least_support and y in least_support:
            value = F.when(F.col("te_count") > least_support[y], value)
        value = F.coalesce(value, F.lit(prior))
        made[f"{out}_{y}"] = value if digits is None else F.round(value, digits)
    return joined.withColumns(made).drop("te_count", *[f"{y}_sum" for y in priors])


def target_encode(train: DataFrame, keys: Sequence[str], target: str, fold: str, smooth: float, out: str,
                  fold_prior: bool = False, min_count: int = 0) -> DataFrame:
    """Out-of-fold mean of the target, all folds at once.

    Sums per (fold, key) minus the key's total give every fold's complement:
    one aggregate and a window over its few lines per key, whatever the number
    of folds; the rows join once. Null targets count neither in sums nor in
    counts. ``fold_prior`` takes the prior from the other folds' rows;
    ``min_count`` pools keys that are rare outside the fold.
    """
    zero = F.lit(0)
    per_fold = stored(train.groupBy(fold, *keys).agg(
        F.coalesce(F.sum(target), zero).alias("_s"), F.count(target).alias("_c"), F.count(F.lit(1)).alias("_r")), train)
    # All further sums come from the per-fold table: the rows are read once to
    # fit and once to apply.
    sums = [F.sum(c).alias(c) for c in ("_s", "_c", "_r")]
    whole = one_row(per_fold.agg(*sums))
    if fold_prior:
        by_fold = per_fold.groupBy(fold).agg(*sums)
        of_fold = small_map(by_fold, fold, F.try_divide(whole["_s"] - F.col("_s"), whole["_c"] - F.col("_c")))
        prior = F.try_element_at(of_fold, F.col(fold))
    else:
        prior = F.try_divide(whole["_s"], whole["_c"])
    same_key = Window.partitionBy(*keys)
    outside = per_fold.select(
        fold, *keys, "_s", "_c", "_r",
        *[F.sum(c).over(same_key).alias(f"_t{c}") for c in ("_s", "_c", "_r")],
    ).withColumns({f"_o{c}": F.col(f"_t{c}") - F.col(c) for c in ("_s", "_c", "_r")})
    total, count = F.col("_o_s"), F.col("_o_c")
    if min_count:
        rare = (F.col("_o_r") > 0) & (F.col("_o_r") <= min_count)
        pooled = F.try_element_at(_pool_rare(outside, keys, fold, min_count), F.col(fold))
        total, count = F.when(rare, pooled["s"]).otherwise(total), F.when(rare, pooled["c"]).otherwise(count)
    value = F.when(count > 0, F.try_divide(total + prior * smooth, count + smooth))
    encoded = stored(outside.select(fold, *keys, value.alias(out)), train)
    return attach(train, encoded, [fold, *keys]).withColumn(out, F.coalesce(F.col(out), prior))


def _pool_rare(outside: DataFrame, keys, fold, min_count) -> Column:
    """Map of fold to the target sum and count of keys with 1..min_count rows
    outside it.

    A key's rows outside a fold equal its total unless it occurs in the fold,
    so rare keys are summed once and corrected where they occur.
    """
    rare = lambda c: (F.col(c) > 0) & (F.col(c) <= min_count)
    picked = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    totals = outside.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_t_s", "_t_c", "_t_r")])
    base = one_row(totals.agg(picked(rare("_t_r"), "_t_s").alias("s"), picked(rare("_t_r"), "_t_c").alias("c")))
    fixes = outside.groupBy(fold).agg(
        *[(picked(rare("_o_r"), f"_o_{x}") - picked(rare("_t_r"), f"_t_{x}")).alias(f"_d{x}") for x in "sc"])
    return small_map(fixes, fold, F.struct((base["s"] + F.col("_ds")).alias("s"), (base["c"] + F.col("_dc")).alias("c")))


def encode_unseen(df: DataFrame, train: DataFrame, keys: Sequence[str], target: str, smooth: float, out: str) -> DataFrame:
    """Encoding of a table that took no part in the fit: all train rows."""
    totals = train.groupBy(*keys).agg(F.sum(target).alias("_s"), F.count(target).alias("_c"))
    whole = totals.agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("m"))
    prior = whole.select("m").scalar()
    table = totals.select(*keys, F.try_divide(F.coalesce("_s", F.lit(0)) + prior * smooth, F.col("_c") + smooth).alias(out))
    return attach(df, stored(table, train), keys).withColumn(out, F.coalesce(F.col(out), prior))


def daily_target_encode(df: DataFrame, keys: Sequence[str], target: str, day: str, weight: float, out: str,
                        held_out: int | None = None, first_from: tuple[int, int, int] | None = None,
                        method: int = 0) -> DataFrame:
    """Each day encoded from the days before it.

    Rows aggregate to (key, day) first, so the window sees one line per key
    and day. Days from ``held_out`` on all use the days before ``held_out``.
    ``first_from=(day, low, high)`` encodes that first day from the later days
    low..high; it leaks by intent and is off by default. Method 0 smooths
    towards the mean of the source days, method 1 uses (sum + w) / (n + 1).
    Keys without history stay null.
    """
    source = F.col(day) if held_out is None else F.least(F.col(day), F.lit(held_out))
    daily = stored(df.groupBy(*keys, source.alias("_d")).agg(F.sum(target).alias("_s"), F.count(target).alias("_c")), df)
    past = Window.partitionBy(*keys).orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    history = daily.select(*keys, "_d", F.sum("_s").over(past).alias("_hs"), F.sum("_c").over(past).alias("_hc"))
    per_day = daily.groupBy("_d").agg(F.sum("_s").alias("_ds"), F.sum("_c").alias("_dc"))
    # One line per day of the calendar: a single small ordered pass.
    before = Window.partitionBy(F.lit(0)).orderBy("_d").rangeBetween(Window.unboundedPreceding, -1)
    means = per_day.select("_d", F.try_divide(F.sum("_ds").over(before), F.sum("_dc").over(before)).alias("_mean"))
    if first_from is not None:
        first, low, high = first_from
        later = df.filter(F.col(day).between(low, high))
        sums = later.groupBy(*keys).agg(F.sum(target).alias("_hs"), F.count(target).alias("_hc")).withColumn("_d", F.lit(first).cast(daily.schema["_d"].dataType))
        history = history.filter(F.col("_d") != first).unionByName(sums.select(*history.columns))
        mean = later.select(F.avg(target)).scalar()
        means = means.withColumn("_mean", F.when(F.col("_d") == first, mean).otherwise(F.col("_mean")))
    # Means join the small history table, so the rows themselves join once.
    table = stored(history.join(means, "_d", "left"), df)
    joined = attach(df.withColumn("_d", source), table, [*keys, "_d"])
    if method == 0:
        value = (F.col("_hs") + F.col("_mean") * weight) / (F.col("_hc") + weight)
    else:
        value = (F.col("_hs") + weight) / (F.col("_hc") + 1)
    known = F.when(F.col("_hc") > 0, value)
    return joined.withColumn(out, known).drop("_hs", "_hc", "_mean", "_d")
