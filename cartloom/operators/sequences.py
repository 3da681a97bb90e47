"""Sessions: building event lists, cutting them, and features around an event.

Lists are only collected once their length is bounded (last n, first n, or
fixed-size chunks); everything that must see a whole session works on its
rows with aggregates, so a session of any length stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.functions import vectors as V
from cartloom.operators.aggregates import one_row
from cartloom.operators.featuremaps import SMALL_MAP
from cartloom.operators.joins import attach, attach_frequent
from cartloom.operators.ordered import Number, ordered_list, ordered_windows, small_map, top_k, with_group
from cartloom.operators.rows import shuffle_rank

CHUNK = 10_000
"""Elements of a list in the queries; the chunk's number is part of the result."""


# --- building ---------------------------------------------------------------

def chunk_lists(df: DataFrame, keys: Sequence[str], order: Sequence, columns: Sequence[str], chunk: int,
                hot_rows: int | None = None) -> DataFrame:
    """Whole ordered lists per group, in chunks of at most ``chunk`` elements.

    A group within the chunk size gives one row (chunk 0); a longer one
    continues in chunk 1, 2, .. so that no list outgrows a task.
    """
    placed = ordered_windows(df, keys, order, {"_pos": Number()}, hot_rows)
    pieces = placed.withColumn("chunk", F.floor((F.col("_pos") - 1) / chunk))
    return ordered_list(pieces, [*keys, "chunk"], "_pos", columns)


def last_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int) -> DataFrame:
    """The last n elements per group as lists in ascending order."""
    backwards = [F.desc(o) for o in order]
    kept = top_k(df, keys, backwards, n, "_from_end").withColumn("_at", -F.col("_from_end"))
    return ordered_list(kept, keys, "_at", columns)


def session_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str] = (),
                    last: Sequence[str] = ()) -> DataFrame:
    """First and last values and the row count per group, without lists."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, at).alias(f"{c}_first") for c in first],
        *[F.max_by(c, at).alias(f"{c}_last") for c in last],
        F.count(F.lit(1)).alias("n"),
    )


def joined_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, n: int,
                 missing: str = "missing") -> DataFrame:
    """The list elements of a group's rows strung together, in chunks of n.

    A group whose lists are all empty yields a single ``missing``.
    """
    items = df.select(*keys, *order, F.posexplode_outer(column).alias("_i", "_item"))
    present = with_group(items, keys, _any=F.count("_item"))
    kept = present.filter(F.col("_item").isNotNull())
    filled = chunk_lists(kept, keys, [*order, "_i"], ["_item"], n).withColumnRenamed("_item_list", "items")
    empty = present.filter(F.col("_any") == 0).select(*keys).distinct()
    empty = empty.select(*keys, F.lit(0).cast("long").alias("chunk"), F.array(F.lit(missing)).alias("items"))
    return filled.unionByName(empty.withColumn("items", F.col("items").cast(filled.schema["items"].dataType)))


def explode_pairs(df: DataFrame, keys: Sequence[str], items: str, values: str, sep: str, clicked: str | None = None,
                  keep: Sequence[str] = (), least: int | Column = 2) -> DataFrame:
    """Candidates of an impression: one row each with position, value and
    label; impressions with fewer than ``least`` candidates are dropped."""
    ids, prices = F.split(items, sep), F.split(values, sep)
    rows = df.withColumn("_ids", ids).filter(F.size("_ids") >= least)
    out = rows.select(*keys, *keep, *([clicked] if clicked else []),
                      F.posexplode(F.arrays_zip(F.col("_ids").alias("item"), prices.alias("value"))).alias("position", "_p"))
    out = out.withColumns({"item": F.col("_p.item"), "value": F.col("_p.value")}).drop("_p")
    if clicked:
        out = out.withColumn("label", F.coalesce((F.col(clicked) == F.col("item")).cast("int"), F.lit(0)))
    return out


def click_events(df: DataFrame, clicked: str, item: str, action: str = "action") -> DataFrame:
    """One synthetic 'click' row per element of the clicked list."""
    rest = [c for c in df.columns if c not in (clicked, item, action)]
    return df.select(*rest, F.explode(clicked).alias(item), F.lit("click").alias(action))


def merge_lists(a: Column, b: Column) -> Column:
    """Elements of both lists without repeats, first occurrence first."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def list_size(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def membership(shown: Column, chosen: Column) -> Column:
    """For each shown element, 1 when it was chosen."""
    return F.transform(shown, lambda x: F.array_contains(chosen, x).cast("int"))


def fresh_items(clicks: DataFrame, session: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Distinct clicked items of a session that it does not have already."""
    match = [*keys, item]
    return clicks.select(*match).distinct().join(session.select(*match).distinct(), match, "left_anti")


def minimum_length(df: DataFrame, keys: Sequence[str], least: int, keep: Column | None = None) -> DataFrame:
    """Rows of sessions of at least so many rows; rows for which ``keep`` holds stay in any case."""
    sized = with_group(df, keys, _n=F.count(F.lit(1)))
    long_enough = F.col("_n") >= least
    return sized.filter(long_enough if keep is None else long_enough | keep).drop("_n")


def keep_last(c: Column, n: int) -> Column:
    return F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c)


def pad(c: Column, n: int, filler=0) -> Column:
    """Cut or fill a list to exactly n elements."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(filler), n)), 1, n)


def cut_at(c: Column, upto: Column) -> Column:
    return F.slice(c, 1, upto)


def placeholder(c: Column, most: int, value=1) -> Column:
    """Append a placeholder, the whole list capped at ``most`` elements."""
    return F.concat(F.slice(c, 1, most - 1), F.array(F.lit(value)))


def scale_elements(df: DataFrame, column: str, fitted_on: DataFrame, out: str) -> DataFrame:
    """Standardise list elements by mean and deviation over all elements."""
    items = fitted_on.select(F.explode(column).alias("x"))
    moments = one_row(items.agg(F.avg("x").alias("a"), F.stddev_samp("x").alias("s")))
    fitted = df.withColumns({"_a": moments["a"], "_s": moments["s"]})
    return fitted.withColumn(out, F.transform(column, lambda x: (x - F.col("_a")) / F.col("_s"))).drop("_a", "_s")


# --- splitting --------------------------------------------------------------

def half_labels(df: DataFrame, keys: Sequence[str], order: Sequence, item: str, is_product: Column, most: int = 20,
                recent: int | None = None, rare=None, hot_rows: int | None = None) -> DataFrame:
    """First half as input, unseen products of the second half as labels.

    The label list keeps first occurrences, leaves out items of the (recent)
    first half unless they carry the rare code, and is cut to ``most``.
    Sessions without labels drop out.
    """
    placed = ordered_windows(df, keys, order, {"_pos": Number()}, hot_rows)
    sized = with_group(placed, keys, _n=F.count(F.lit(1)))
    border = F.col("_n") - F.floor(F.col("_n") / 2)
    sides = sized.withColumn("_late", F.col("_pos") > border)
    early = ~F.col("_late")
    if recent is not None:
        early = early & (F.col("_pos") > border - recent)
    seen = F.max(early.cast("int"))
    first = F.min(F.when(F.col("_late") & is_product, F.col("_pos")))
    items = sides.groupBy(*keys, item).agg(seen.alias("_seen"), first.alias("_first"))
    fresh = F.col("_seen") == 0
    if rare is not None:
        fresh = fresh | (F.col(item) == rare)
    labels = items.filter(F.col("_first").isNotNull() & fresh)
    ranked = top_k(labels, keys, ["_first"], most, "_rank")
    lists = ordered_list(ranked, keys, "_rank", [item]).withColumnRenamed(f"{item}_list", "labels")
    halves = sides.groupBy(*keys).agg(F.max("_n").alias("n"), F.count_if(~F.col("_late")).alias("n_input"))
    return halves.join(lists, list(keys))


def first_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, item: str,
                at: str, none="none") -> DataFrame:
    """Per group the first row meeting a condition: id, flag and time.

    Groups without one get the default id, flag 0 and their last time.
    """
    spot = F.struct(*order)
    hit = F.when(condition, spot)
    return df.groupBy(*keys).agg(
        F.coalesce(F.min_by(item, hit), F.lit(none)).alias("first_id"),
        F.max(condition.cast("int")).alias("has_event"),
        F.coalesce(F.min_by(at, hit), F.max(at)).alias("event_at"),
    )


def until_event(df: DataFrame, events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows up to and including the group's event time."""
    return attach(df, events, keys).filter(F.col(at) <= F.col("event_at"))


def around_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Rows of groups with a qualifying row, marked by their place around it.

    ``_spot`` is the first qualifying row, ``side`` is -1, 0 or 1.
    """
    spot = F.struct(*order)
    firsts = df.groupBy(*keys).agg(F.min(F.when(condition, spot)).alias("_spot"))
    marked = attach(df, firsts.filter(F.col("_spot").isNotNull()), keys, how="inner")
    here = F.struct(*order)
    side = F.when(here < F.col("_spot"), -1).when(here == F.col("_spot"), 0).otherwise(1)
    return marked.withColumn("side", side)


def event_position(around: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Id at the event, its 0-based position and the number of rows after it."""
    return around.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == 0, F.col(item))).alias("event_item"),
        F.count_if(F.col("side") < 0).alias("position"),
        F.count_if(F.col("side") > 0).alias("n_after"),
    )


def side_counts(around: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Sums of 0/1 flags before and after the event."""
    made = []
    for name, flag in flags.items():
        for side, label in ((-1, "before"), (1, "after")):
            made.append(F.sum(F.when(F.col("side") == side, flag.cast("int")).otherwise(0)).alias(f"{name}_{label}"))
    return around.groupBy(*keys).agg(*made)


def event_attributes(around: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The listed columns as they stand at the event's row."""
    return around.filter(F.col("side") == 0).select(*keys, *[F.col(c).alias(f"event_{c}") for c in columns])


def session_totals(df: DataFrame, keys: Sequence[str], item: str, is_query: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.countDistinct(item).alias("n_items"),
        F.count_if(is_query).alias("n_queries"),
    )


def spread_neighbours(around: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, object],
                      p: int = 5) -> DataFrame:
    """Last p rows after the event and first p rows before it, spread into
    ``<column>_after_i`` and ``<column>_before_i`` with defaults."""
    after = top_k(around.filter(F.col("side") > 0), keys, [F.desc(o) for o in order], p, "_r")
    sizes = with_group(after, keys, _m=F.max("_r"))
    after = sizes.withColumn("_slot", F.col("_m") - F.col("_r")).withColumn("_where", F.lit("after")).drop("_m", "_r")
    before = top_k(around.filter(F.col("side") < 0), keys, list(order), p, "_r")
    before = before.withColumn("_slot", F.col("_r") - 1).withColumn("_where", F.lit("before")).drop("_r")
    both = after.unionByName(before)
    made = []
    for where in ("after", "before"):
        for c, default in columns.items():
            for i in range(p):
                here = (F.col("_where") == where) & (F.col("_slot") == i)
                made.append(F.coalesce(F.max(F.when(here, F.col(c))), F.lit(default)).alias(f"{c}_{where}_{i}"))
    groups = around.select(*keys).distinct()
    return groups.join(both.groupBy(*keys).agg(*made), list(keys), "left").fillna(
        {f"{c}_{w}_{i}": d for c, d in columns.items() for w in ("after", "before") for i in range(p)})


def cut_points(around: DataFrame, keys: Sequence[str], order: Sequence, top: int = 10,
               hot_rows: int | None = None) -> DataFrame:
    """Session copies ending 0, 2, 4, .. rows after the event: one line each
    with the kept length. The copies' rows follow by joining on position."""
    sized = around.groupBy(*keys).agg(
        F.count_if(F.col("side") < 0).alias("position"), F.count_if(F.col("side") > 0).alias("n_after"))
    snapped = F.least(F.lit(top), (F.floor(F.col("n_after") / 2) * 2)).cast("int")
    cuts = sized.withColumn("cut", F.explode(F.sequence(F.lit(0), snapped, F.lit(2))))
    return cuts.select(*keys, "cut", (F.col("position") + F.col("cut") + 1).alias("kept"))


def rows_of_cuts(df: DataFrame, cuts: DataFrame, keys: Sequence[str], order: Sequence,
                 hot_rows: int | None = None) -> DataFrame:
    """The rows of every session copy, keyed by (session, cut)."""
    placed = ordered_windows(df, keys, order, {"position": Number()}, hot_rows)
    return placed.join(cuts, list(keys)).filter(F.col("position") <= F.col("kept")).drop("kept")


def resample_to(df: DataFrame, key: Sequence[str], bucket: str, split: str, source: str, target: str,
                seed: int = 0, hot_rows: int | None = None, balanced: bool = False) -> DataFrame:
    """Bring one split's bucket shares to another's by truncating to bucket 0.

    With ``balanced`` the aim is the mean of the two splits' shares. Per bucket above 0 the surplus of the source split, counted in rows, is
    drawn by seeded hash order; drawn rows get ``new_<bucket>`` 0.
    """
    counts = df.groupBy(bucket).agg(
        F.count_if(F.col(split) == source).alias("_a"), F.count_if(F.col(split) == target).alias("_b"))
    totals = one_row(counts.agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")))
    n_a, n_b = totals["a"], totals["b"]
    share, aim = F.try_divide(F.col("_a"), n_a), F.try_divide(F.col("_b"), n_b)
    surplus = (share - ((share + aim) / 2 if balanced else aim)) * n_a
    quota = small_map(counts, bucket, F.floor(surplus + 1e-9))
    drawn = df.filter((F.col(split) == source) & (F.col(bucket) > 0)).withColumn("_draw", shuffle_rank(key, seed))
    placed = ordered_windows(drawn, [bucket], ["_draw", *key], {"_place": Number()}, hot_rows)
    drawn_all = placed.filter(F.col("_place") <= F.try_element_at(quota, F.col(bucket)))
    hit = drawn_all.select(*key, F.lit(1).alias("_hit"))
    marked = df.join(hit, list(key), "left")
    return marked.withColumn(f"new_{bucket}", F.when(F.col("_hit") == 1, 0).otherwise(F.col(bucket))).drop("_hit")


# --- vectors ----------------------------------------------------------------

def vectors_or_zero(items: DataFrame, vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Every item with its vector, a zero vector where it has none."""
    joined = items.join(vectors.select(key, vector), key, "left")
    kind = joined.schema[vector].dataType
    return joined.withColumn(vector, F.coalesce(F.col(vector), F.array_repeat(F.lit(0.0), size).cast(kind)))


def event_similarity(around: DataFrame, keys: Sequence[str], item: str, vectors: DataFrame, vec_key: str,
                     vector: str, name: str) -> DataFrame:
    """Cosine distance of the event's item to the group's other distinct items:
    mean and population deviation over all, before and after; 0 for none."""
    sides = around.groupBy(*keys, item).agg(
        F.max((F.col("side") < 0).cast("int")).alias("_before"),
        F.max((F.col("side") > 0).cast("int")).alias("_after"),
        F.max((F.col("side") == 0).cast("int")).alias("_event"),
    )
    vec = vectors.select(F.col(vec_key).alias("_vk"), F.col(vector).alias("_v"))
    with_vec = attach(sides, vec, {item: "_vk"}, how="inner")
    event = with_vec.filter(F.col("_event") == 1).select(*keys, F.col(item).alias("_ei"), F.col("_v").alias("_ev"))
    pairs = attach(with_vec, event, keys, how="inner").withColumn("_d", V.cosine_distance(F.col("_ev"), F.col("_v")))
    scopes = {"all": F.col(item) != F.col("_ei"), "before": F.col("_before") == 1, "after": F.col("_after") == 1}
    made = []
    for scope, cond in scopes.items():
        value = F.when(cond, F.col("_d"))
        made += [F.avg(value).alias(f"{name}_mean_{scope}"), F.stddev_pop(value).alias(f"{name}_std_{scope}")]
    found = pairs.groupBy(*keys).agg(*made)
    out = around.select(*keys).distinct().join(found, list(keys), "left")
    return out.fillna(0.0, [c for c in out.columns if c.startswith(name)])


def category_shares(around: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Distinct categories per row, and the share of the event's category."""
    event = around.filter(F.col("side") == 0).select(*keys, F.col(category).alias("_ec"))
    return attach(around, event, keys).groupBy(*keys).agg(
        (F.countDistinct(category) / F.count(F.lit(1))).alias("category_diversity"),
        F.avg((F.col(category) == F.col("_ec")).cast("int")).alias("category_share"),
    )


def item_embeddings(lists: DataFrame, column: str, size: int = 16, min_count: int = 1, partitions: int | None = None,
                    seed: int = 42, window: int = 5, iterations: int = 1):
    """Word2Vec over session product lists; the model finds nearest items.

    Trained in one task for each shuffle partition unless told otherwise. Spark
    keeps the vocabulary with its vectors on the driver; ``min_count`` bounds it.
    """
    from pyspark.ml.feature import Word2Vec

    partitions = partitions or int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Word2Vec(inputCol=column, outputCol="vector", vectorSize=size, minCount=min_count, seed=seed,
                    numPartitions=partitions, windowSize=window, maxIter=iterations).fit(lists)


def decode_tokens(tokens: DataFrame, keys: Sequence[str], place: str, code: str, vocab: DataFrame, out: str,
                  skewed: bool = False) -> DataFrame:
    """Text from token ids: look up, put in order, join, merge '##' pieces.

    One output row is one text, so its tokens are bounded by the text itself.
    ``skewed`` is that of ``encoders.encode``.
    """
    table = vocab.select("code", F.col("value").alias("_word"), *(["n"] if skewed else []))
    words = attach_frequent(tokens, table, {code: "code"}, "n", SMALL_MAP) if skewed else attach(tokens, table, {code: "code"})
    lists = ordered_list(words.select(*keys, place, "_word"), keys, place, ["_word"])
    joined = F.replace(F.array_join("_word_list", " "), F.lit(" ##"), F.lit(""))
    return lists.select(*keys, joined.alias(out))
