"""Numeric band join: linear buckets for the absolute band, logarithmic ones for the relative band."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A pair is near if its gap is at most ABSOLUTE, or 1000 * gap at most PER_MILLE * p; FIRST of them are listed.
ABSOLUTE, PER_MILLE, FIRST = 10, 2, 5


def _div(value: Column, by: Column) -> Column:
    """floor(value / by) of integers, negative values too; by > 0."""
    return F.call_function("div", value - F.pmod(value, by), by)


def band_pairs(left: DataFrame, right: DataFrame, p: str = "p", u: str = "u", absolute: int = ABSOLUTE, per_mille: int = PER_MILLE) -> tuple[DataFrame, DataFrame]:
    """Pairs of rows with abs(u - p) = gap at most `absolute`; and those beyond it with 1000 * gap at most per_mille * p.

    p and u are long columns without nulls. Both results have the columns of left and right, `bucket` and `gap`,
    and are dealt by bucket. A linear bucket is as wide as the whole absolute band, a
    logarithmic one as the whole relative band, so that a row of left is in two of each at most.
    The relative branch has only values of p whose relative band is the wider one, and only pairs outside the absolute band, so no pair comes twice.
    """
    pc, uc = F.col(p), F.col(u)
    gap = F.abs(uc - pc).alias("gap")
    wide = F.lit(2 * absolute + 1)
    of = lambda low, high: F.explode(F.array_distinct(F.array(low, high))).alias("bucket")
    near = left.select("*", of(_div(pc - absolute, wide), _div(pc + absolute, wide))).join(right.select("*", _div(uc, wide).alias("bucket")), "bucket")
    near = near.select("*", gap).where(F.col("gap") <= absolute)
    # The same function of integers on both sides, and it never falls: a value between two others has a bucket between theirs.
    step = math.log((1000 + per_mille) / (1000 - per_mille)) + 1e-9
    log = lambda x: F.floor(F.log(x.cast("double")) / step)
    reach = _div(pc * per_mille, F.lit(1000))
    far = left.where(pc * per_mille > 1000 * absolute).select("*", of(log(pc - reach), log(pc + reach)))
    far = far.join(right.where(uc > 0).select("*", log(uc).alias("bucket")), "bucket")
    return near, far.select("*", gap).where((F.col("gap") > absolute) & (1000 * F.col("gap") <= per_mille * pc))


def cents(x: Column) -> Column:
    """floor(100 * x + 0.5), null for what is no finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < 1e16), F.floor(F.lit(100.0) * x + F.lit(0.5)))


def unit_cents(amount: Column, quantity: Column) -> Column:
    """floor((2 * amount + quantity) / (2 * quantity)) in integers, amount in cents; null for a quantity of zero."""
    q = quantity.cast("long")
    by = F.when(q != 0, F.abs(2 * q))
    return _div((2 * amount + q) * F.signum(q).cast("long"), by)


def _priced_lines(lines: DataFrame) -> DataFrame:
    """u, item, sale, line and crc of the lines that may pair."""
    rows = lines.where("sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL")
    sale, line, item = (F.col(c).cast("long") for c in ("sale_id", "line_no", "item_id"))
    text = F.concat(sale.cast("string"), F.lit(","), F.coalesce(line.cast("string"), F.lit("")), F.lit(","), item.cast("string"))
    u = unit_cents(cents(F.col("amount")), F.col("quantity")).alias("u")
    return rows.select(u, item.alias("item"), sale.alias("sale"), line.alias("line"), F.crc32(text).alias("crc")).where("u IS NOT NULL")


def near_prices(lines: DataFrame, items: DataFrame, absolute: int = ABSOLUTE, per_mille: int = PER_MILLE, first: int = FIRST) -> DataFrame:
    """Each item's first pairs with lines of other items at near unit prices, and sums over all its pairs.

    Rows: item_id, rank (from 1), gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc; an item without
    pairs has one row of rank 0, nulls and zeros.

    Pairs of items and lines are never made: lines are summed by unit price and item, then by unit price, items by price,
    and only distinct prices and unit prices are joined (`band_pairs`). An item's own lines
    are taken off its price's sums by an equi-join. Of each unit price the first lines are kept, no more than `first` of an item and twice
    that many in all: whichever item is left out, the `first` of the others are among them; the same holds for a price. Sums
    are partial before each shuffle and ranks limited before it, so a hot item, sale or price sends a few rows a task.
    Defined cases: lines null in sale_id, item_id, quantity or amount, with a quantity of zero or an amount that is no finite
    number, and items null in price or item_id never pair; a null line_no is the last, and empty in the text
    of the checksum; repeated lines count and rank each; a repeated row of items has its rows again; empty
    tables give no pairs; extra columns are ignored; sums beyond a long are an error.
    """
    priced = _priced_lines(lines)
    by_item = written(priced.groupBy("u", "item").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "unit-prices")
    order = [F.col("sale"), F.col("line").asc_nulls_last(), F.col("item")]
    own = priced.select("u", "item", "sale", "line").withColumn("k", F.row_number().over(Window.partitionBy("u", "item").orderBy(*order))).where(F.col("k") <= first)
    some = own.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("k") <= 2 * first)
    some = some.groupBy("u").agg(F.collect_list(F.struct("sale", "line", "item")).alias("lines"))
    # Lines that are surely left of a unit price, whichever item is left out.
    most = F.array_max(F.transform("lines", lambda x: F.size(F.filter("lines", lambda y: y["item"] == x["item"]))))
    units = by_item.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(some.withColumn("sure", F.size("lines") - most), "u")

    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(F.col("item_id").isNotNull(), cents(F.col("price"))).alias("p"))
    prices = wanted.where("p IS NOT NULL").select("p").distinct()

    def summed(pairs: DataFrame) -> DataFrame:
        """The sums of each bucket and price at its nearest pair, and as many pairs as its first lines can need."""
        w = Window.partitionBy("bucket", "p").orderBy("gap", "u")
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.coalesce(F.sum("sure").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        one = F.row_number().over(w) == 1
        sums = [F.when(one, F.sum(x).over(every)).alias(name) for name, x in (("n", F.col("n")), ("gaps", F.col("n") * F.col("gap")), ("crc", F.col("crc")))]
        return pairs.select("p", "gap", "u", "lines", before.alias("before"), *sums).where(F.col("before") < first)

    near, far = band_pairs(prices, units, absolute=absolute, per_mille=per_mille)
    found = written(summed(near).unionByName(summed(far)), "near-prices")
    totals = found.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.sum("crc").alias("crc"))
    place = [F.col("gap"), F.col("u"), *order]
    each = found.select("p", "gap", "u", F.inline("lines")).withColumn("k", F.row_number().over(Window.partitionBy("p", "item").orderBy(*place))).where(F.col("k") <= first)
    each = each.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy(*place))).where(F.col("k") <= 2 * first)
    heads = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "gap", "u", "sale", "line", "item"))).alias("head"))

    gap = F.abs(F.col("u") - F.col("p"))
    in_band = (gap <= absolute) | (1000 * gap <= per_mille * F.col("p"))
    itself = wanted.where("p IS NOT NULL").distinct().join(by_item.withColumnRenamed("item", "item_id"), "item_id").where(in_band)
    itself = itself.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * gap).alias("own_gaps"), F.sum("crc").alias("own_crc"))
    out = wanted.join(itself, ["item_id", "p"], "left").join(totals.join(heads, "p", "left"), "p", "left")
    less = lambda a, b: (F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).cast("long")
    head = F.slice(F.filter("head", lambda x: x["item"] != F.col("item_id")), 1, first)
    out = out.select("item_id", head.alias("head"), less("n", "own_n").alias("n_pairs"), less("gaps", "own_gaps").alias("gap_sum"), less("crc", "own_crc").alias("lines_crc"))
    out = out.select("item_id", F.posexplode_outer("head").alias("pos", "x"), "n_pairs", "gap_sum", "lines_crc")
    rank = F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("rank")
    return out.select("item_id", rank, F.col("x.gap").alias("gap"), F.col("x.u").alias("u"), F.col("x.sale").alias("sale_id"), F.col("x.line").alias("line_no"), F.col("x.item").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")
