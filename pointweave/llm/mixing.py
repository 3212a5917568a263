"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source gets the same copy fraction f = target / source size. The whole part of f is taken as it
is. The rest, p, is rounded by pairs: two documents exchange words (not probability alone, so that the words taken
from the source stay the same) until one of the two has a whole number of copies; the other goes on to the next pair.
The direction of each exchange is random, with the chances that keep every document's expected copies at f.
Blocks of documents are folded independently; the one undecided document of each block goes to the next level of a
tree of blocks, until a source has one undecided document left, which is rounded at random. The words taken from a
source then miss its target by less than one document; a last step turns over short documents for the rest, chosen by
running sums over all of the source.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, distinct_rows, materialize, uniform

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 48
#: Rounds in which documents are turned over until a source meets its target.
SETTLING = 3
_WHOLE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources share `share` times the sum of all sizes by weight; a target stops at `most` times its source's size and
    the excess goes to the others by weight until none is above. That is the level r at which the sum of
    min(most * size, r * weight) is the amount to share: sources ordered by size / weight fill up one after the other,
    and r follows from what is left after the filled ones. A source without words has target 0.
    Only sources are ordered here, never documents.
    """
    by_name = Window.orderBy(F.col(source).cast("binary").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    every = Window.orderBy("__ratio", F.col(source).cast("binary").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    all_ = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left_w = F.sum("__w").over(every.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(all_)
    t = (
        sizes.withColumn("__w", weight)
        .withColumn("__cap", F.lit(most) * F.col("source_size"))
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__level", (budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / left_w)
    )
    # The level is that of the first source which is not filled by it; if all are filled, none is left to limit.
    first = F.min(F.when(F.col("__level") < F.col("__ratio"), F.struct("__ratio", "__level"))).over(all_)
    t = t.withColumn("__r", first["__level"])
    return t.withColumn("target", F.when(F.col("__r").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__r") * F.col("__w")))).drop("__w", "__cap", "__ratio", "__level", "__r")


def _fold(items: Column, seed: int) -> Column:
    """Fold an array of struct(id, size, x), 0 < x < 1, to struct(open: the undecided item or null, done: array<struct(id, take)>)."""
    item = "struct<id:struct<doc_id:bigint,size:bigint,copy_no:bigint>,size:double,x:double>"
    done = "array<struct<id:struct<doc_id:bigint,size:bigint,copy_no:bigint>,take:int>>"

    def pair(acc: Column, b: Column) -> Column:
        a = acc["open"]
        # In words: `up` moves from b to a, `down` from a to b, as far as either becomes whole.
        up = F.least((1 - a["x"]) * a["size"], b["x"] * b["size"])
        down = F.least(a["x"] * a["size"], (1 - b["x"]) * b["size"])
        goes_up = uniform(seed, a["id"], b["id"]) * (up + down) < down
        move = F.when(goes_up, up).otherwise(-down)
        return F.struct(F.struct(a["id"].alias("id"), a["size"].alias("size"), (a["x"] + move / a["size"]).alias("x")).alias("a"), F.struct(b["id"].alias("id"), b["size"].alias("size"), (b["x"] - move / b["size"]).alias("x")).alias("b"))

    def whole(y: Column) -> Column:
        return (y["x"] <= _WHOLE) | (y["x"] >= 1 - _WHOLE)

    def decided(y: Column) -> Column:
        return F.filter(F.array(F.struct(y["id"].alias("id"), F.round(y["x"]).cast("int").alias("take"))), lambda _: whole(y))

    def step(acc: Column, b: Column) -> Column:
        def next_of(p: Column) -> Column:
            a2, b2 = p["a"], p["b"]
            left = F.when(~whole(a2), a2).when(~whole(b2), b2).cast(item)
            return F.struct(left.alias("open"), F.concat(acc["done"], decided(a2), decided(b2)).alias("done"))

        paired = F.transform(F.array(pair(acc, b)), next_of)[0]  # the array binds the pair once for its three uses
        return F.when(acc["open"].isNull(), F.struct(b.cast(item).alias("open"), acc["done"].alias("done"))).otherwise(paired)

    return F.aggregate(items, F.struct(F.lit(None).cast(item).alias("open"), F.lit(None).cast(done).alias("done")).withField("done", F.array().cast(done)), step)


def mix(docs: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, source, copy_no, copies.

    Null text has size 0; null source is a source of its own, last in order; null or repeated doc_id and repeated rows
    count as rows (copy_no tells equal ones apart). A document without words gets the whole part of its fraction.
    An empty table gives an empty result. Other columns are ignored.
    """
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col("text")).alias("size"))
    rows = materialize(distinct_rows(flat, ["doc_id", "source", "size"]), "mix-rows")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    goal = materialize(targets(by_source, "source", weights, share, most), "mix-targets")
    goal = goal.withColumn("__f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("__base", F.floor(F.col("__f") + _WHOLE)).withColumn("__p", F.greatest(F.col("__f") - F.col("__base"), F.lit(0.0)))
    most_rows = goal.agg(F.max("source_rows")).first()[0] or 0
    todo = goal.select(F.col("source").alias("__s"), "source_rows", F.col("__p"))
    open_ = (
        rows.where("size > 0")
        .join(todo, F.col("source").eqNullSafe(F.col("__s")))
        .where(F.col("__p") > _WHOLE)
        .select("source", F.struct(F.struct("doc_id", "size", "copy_no").alias("id"), F.col("size").cast("double").alias("size"), F.col("__p").alias("x")).alias("item"), "source_rows")
    )
    taken = None
    # The number of levels follows from the largest source: each level leaves one open document of each block.
    levels = max(1, math.ceil(math.log(max(most_rows, 2)) / math.log(block)))
    blocks = F.greatest(F.ceil(F.col("source_rows") / block), F.lit(1))
    for level in range(levels + 1):
        last = level == levels
        key = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(seed + level), F.col("item.id")), blocks)
        grouped = open_.withColumn("__b", key).groupBy("source", "source_rows", "__b").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = materialize(grouped.select("source", F.col("__b"), F.col("source_rows"), _fold(F.col("items"), seed + level).alias("r")), f"mix-level{level}")
        out = folded.select("source", F.explode("r.done").alias("d")).select("source", F.col("d.id").alias("id"), F.col("d.take").alias("take"))
        taken = out if taken is None else taken.unionByName(out)
        # One open document remains of each block; the next level has so many fewer documents for the source.
        open_ = folded.where(F.col("r.open").isNotNull()).select("source", F.col("r.open").alias("item"), F.greatest(F.ceil(F.col("source_rows") / block), F.lit(1)).alias("source_rows"))
    end = open_.select("source", F.col("item.id").alias("id"), F.when(uniform(seed - 1, F.col("item.id")) < F.col("item.x"), 1).otherwise(0).alias("take"))
    taken = taken.unionByName(end).select(F.col("source").alias("__ts"), F.col("id.doc_id").alias("__td"), F.col("id.size").alias("__tz"), F.col("id.copy_no").alias("__tc"), "take")
    on = F.col("doc_id").eqNullSafe(F.col("__td")) & F.col("source").eqNullSafe(F.col("__ts")) & (F.col("size") == F.col("__tz")) & (F.col("copy_no") == F.col("__tc"))
    goals = goal.select(F.col("source").alias("__g"), "source_size", F.col("target").cast("double").alias("target"), "__base")
    rounded = rows.join(taken, on, "left").join(goals, F.col("source").eqNullSafe(F.col("__g")), "left").select("doc_id", "source", "copy_no", "size", "source_size", "target", F.col("__base").cast("long").alias("base"), "take")
    rounded = materialize(rounded, "mix-rounded")
    settled = _settle(rounded, seed)
    flip = (F.col("take") == F.col("__wanted")) & (_turned(SETTLING) | ((F.col("size") <= F.col("__left")) & F.coalesce(F.array_contains("__ids", F.struct("doc_id", "size", "copy_no")), F.lit(False))))
    turning = rounded.withColumns(_order(seed)).join(settled, F.col("source").eqNullSafe(F.col("__g")), "left")
    copies = F.col("base") + F.when(flip, 1 - F.col("take")).otherwise(F.coalesce(F.col("take"), F.lit(0)))
    return turning.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "source", "copy_no", copies.cast("long").alias("copies"))


def _order(seed: int) -> dict[str, Column]:
    """A document's place in random order and its size class."""
    return {"__u": uniform(seed - 2, F.struct("doc_id", "size", "copy_no")), "__class": F.floor(F.log2("size"))}


def _turned(rounds: int) -> Column:
    """Whether one of the first rounds has turned a document over whose rounding is the one wanted."""
    now = [(F.col("size") <= F.col(f"__left{k}")) & (F.col("__class") <= F.col(f"__top{k}")) & (F.col("__u") < F.col(f"__cut{k}")) for k in range(rounds)]
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), now, F.lit(False))


def _settle(rounded: DataFrame, seed: int, rounds: int = SETTLING, most: int = 256) -> DataFrame:
    """Which documents' last roundings are turned over, so that a source's words meet its target: a row for each source.

    What the tree leaves is less than one document, but that document may be long. Each round looks at all documents
    of a source that are no longer than the miss: counts by size class give the shortest classes that hold twice the
    miss, and of those, documents are turned in random order as long as their running sum fits. What is left is less
    than one of them, so the next round has shorter ones. At last the longest that fit of `most` more are turned.

    A round is three numbers of each source (__left, __top, __cut, with the round's number), by which any document can
    tell whether it was turned; __ids are the last ones. So documents meet one small table once in each step, and the
    driver keeps few broadcast tables.
    """
    miss = rounded.groupBy("source").agg((F.sum((F.col("base") + F.coalesce(F.col("take"), F.lit(0))) * F.col("size")) - F.first("target")).alias("miss"))
    state = materialize(miss.select(F.col("source").alias("__g"), F.when(F.col("miss") > 0, 1).otherwise(0).alias("__wanted"), F.abs("miss").alias("__left")), "mix-miss")
    docs = rounded.where("take is not null and size > 0").select("source", "take", "size", F.struct("doc_id", "size", "copy_no").alias("id"), *[c.alias(name) for name, c in _order(seed).items()])
    bucket = F.floor(F.col("__u") * 4096)

    def fitting(sources: DataFrame, k: int) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("__g")) & (F.col("take") == F.col("__wanted")) & (F.col("size") <= F.col("__left"))
        return docs.join(sources, same).where(~_turned(k))

    for k in range(rounds):
        own = [F.first(c).alias(c) for c in state.columns if c != "__g"]
        classes = fitting(state, k).groupBy("__g", "__class").agg(F.sum("size").alias("n"), *own).withColumn("sum", F.sum("n").over(Window.partitionBy("__g").orderBy("__class")))
        top = classes.groupBy("__g").agg(F.coalesce(F.min(F.when(F.col("sum") >= 2 * F.col("__left"), F.col("__class"))), F.max("__class")).alias("__top"), *own)
        top = materialize(top, f"mix-class{k}")
        # Sums by bucket of the random order first; only the bucket in which the miss is reached is sorted.
        own.append(F.first("__top").alias("__top"))
        buckets = fitting(top, k).where("__class <= __top").groupBy("__g", bucket.alias("__b")).agg(F.sum("size").alias("n"), *own).withColumn("sum", F.sum("n").over(Window.partitionBy("__g").orderBy("__b")))
        here = buckets.groupBy("__g").agg(F.min(F.when(F.col("sum") > F.col("__left"), F.struct("__b", (F.col("sum") - F.col("n")).alias("before")))).alias("__c"), F.max("sum").alias("__all"), *own)
        here = materialize(here.withColumns({"__hb": F.col("__c.__b"), "__before": F.col("__c.before")}).drop("__c"), f"mix-bucket{k}")
        inside = fitting(here, k).where((F.col("__class") <= F.col("__top")) & (bucket == F.col("__hb"))).withColumn("sum", F.col("__before") + F.sum("size").over(Window.partitionBy("__g").orderBy("__u", "id")))
        end = inside.where("sum > __left").select("__g", F.struct("__u", (F.col("sum") - F.col("size")).alias("used")).alias("__end"))
        # The rows of a source are put together: a source in which nothing fits has only that of the state.
        every = state.unionByName(here.select("__g", "__top", "__all"), allowMissingColumns=True).unionByName(end, allowMissingColumns=True)
        every = every.groupBy("__g").agg(*[F.first(c, True).alias(c) for c in [*state.columns[1:], "__top", "__all"]], F.min("__end").alias("__end"))
        limits = [F.col("__left").alias(f"__left{k}"), F.col("__top").alias(f"__top{k}"), F.coalesce("__end.__u", F.lit(2.0)).alias(f"__cut{k}")]
        left = F.col("__left") - F.coalesce("__end.used", "__all", F.lit(0))
        state = materialize(every.select(*[left.alias(c) if c == "__left" else F.col(c) for c in state.columns], *limits), f"mix-cut{k}")
    # The first `most` of each source in random order: of each of 64 slices of that order's numbers, then of the source.
    some = fitting(state, rounds).withColumn("__slice", F.pmod(F.floor(F.col("__u") * (1 << 20)), F.lit(64)))
    for keys in (["__g", "__slice"], ["__g"]):
        some = some.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("__u", "id"))).where(F.col("__i") <= most).drop("__i")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "__u", "id")))
    kind = "array<struct<doc_id:bigint,size:bigint,copy_no:bigint>>"

    def fit(acc: Column, x: Column) -> Column:
        fits = acc["left"] >= -x["neg"]
        return F.struct((acc["left"] + F.when(fits, x["neg"]).otherwise(F.lit(0))).alias("left"), F.concat(acc["ids"], F.filter(F.array(x["id"]), lambda _: fits)).cast(kind).alias("ids"))

    folded = some.groupBy("__g").agg(ordered.alias("a"), F.first("__left").alias("left"))
    ids = folded.select("__g", F.aggregate("a", F.struct(F.col("left").cast("double").alias("left"), F.array().cast(kind).alias("ids")), fit)["ids"].alias("__ids"))
    every = state.unionByName(ids, allowMissingColumns=True).groupBy("__g").agg(*[F.first(c, True).alias(c) for c in [*state.columns[1:], "__ids"]])
    return materialize(every, "mix-settled")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, columns as in docs."""
    size = word_count(F.col("text"))
    plan = mix(docs, **options).select(F.col("doc_id").alias("__mix__d"), F.col("source").alias("__mix__s"), F.col("size").alias("__mix__z"), "copy_no", "copies")
    # Equal (doc_id, source, size) rows share a sum of copies; the k-th of them takes what copy_no k was given.
    per = plan.groupBy("__mix__d", "__mix__s", "__mix__z").agg(F.sum("copies").alias("__mix__sum"), F.count(F.lit(1)).alias("__mix__n"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__mix__d")) & F.col("source").eqNullSafe(F.col("__mix__s")) & (size == F.col("__mix__z"))
    per = materialize(per.where("__mix__sum > 0"), "mix-copies")
    # Documents meet their copies by a shuffle at any size: what is on either side grows with the corpus.
    taken = docs.join(per.where("__mix__n = 1").hint("merge"), on).withColumn("__mix__c", F.col("__mix__sum"))
    if not (repeated := per.where("__mix__n > 1")).isEmpty():
        base = F.floor(F.col("__mix__sum") / F.col("__mix__n"))
        nth = F.row_number().over(Window.partitionBy("__mix__d", "__mix__s", "__mix__z").orderBy(F.xxhash64("text")))
        many = docs.join(repeated, on).withColumn("__mix__nth", nth).withColumn("__mix__c", base + F.when(F.col("__mix__nth") <= F.col("__mix__sum") - base * F.col("__mix__n"), 1).otherwise(0)).drop("__mix__nth")
        taken = taken.unionByName(many)
    return taken.where("__mix__c > 0").withColumn("__mix__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix__c").cast("long")))).select(*docs.columns)
