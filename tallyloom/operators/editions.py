"""Two editions of a register: content keys, flows, transitions, and how far the linkage can be trusted."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import core_name, strip

KEY = ("publisher", "location_text", "voltage_level", "resource_class", "capacity_injected", "capacity_withdrawn")
NODE_KEY = ("publisher", "node_id", "location_text", "voltage_level")
IDENTITY = ("_applicant", "_facility_name")
HELD_OUT = ("_applicant", "_facility_name", "date_application")

# The order of statuses, and those that end a case without connection.
STATUS_ORDER = {"APPLICATION_FILED": 0, "APPLICATION_INCOMPLETE": 1, "UNDER_REVIEW": 2, "CONDITIONS_ISSUED": 3, "AGREEMENT_IN_FORCE": 4, "CONNECTED": 5}
TERMINAL = ("REFUSED", "APPLICATION_WITHDRAWN", "CONDITIONS_EXPIRED")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def with_key(df: DataFrame, fields: tuple[str, ...] = KEY, zero_as_missing: bool = False) -> DataFrame:
    """df with key: a struct of the fields' texts, in which missing is a value."""
    have = [c for c in fields if c in df.columns]
    if not have:
        raise ValueError(f"none of the key fields is present: {fields}")
    part = lambda c: F.when(F.col(c).try_cast("double") == 0, F.lit("")).otherwise(_text(F.col(c))) if zero_as_missing else _text(F.col(c))
    return df.withColumn("key", F.struct(*[part(c).alias(c) for c in have]))


def first_per_key(df: DataFrame, order: str = "_seq") -> DataFrame:
    """The first row of each key in input order, and how many rows the key has (n_rows)."""
    own = [c for c in df.columns if c != "key"]
    return df.groupBy("key").agg(F.min_by(F.struct(*own), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n_rows")).select("key", "n_rows", "r.*")


def pairs(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY, order: str = "_seq", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Both editions by key: a and b are the first rows (null where the key is missing), n_a and n_b their row counts. Of the columns only those to keep go along, if they are named: Spark does not prune the fields of an aggregated struct."""
    sides = []
    for df, s in ((a, "a"), (b, "b")):
        keyed = with_key(df, fields)
        if keep is not None:
            keyed = keyed.select("key", order, *[c for c in keep if c in df.columns and c != order])
        first = first_per_key(keyed, order)
        sides.append(first.select("key", F.col("n_rows").alias(f"n_{s}"), F.struct(*[c for c in first.columns if c not in ("key", "n_rows")]).alias(s)))
    return sides[0].join(sides[1], "key", "full_outer")


def _order(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS_ORDER.items() for x in kv])[c]


def compare(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY) -> DataFrame:
    """One row of flows between two editions."""
    p = pairs(a, b, fields, keep=("process_status",))
    sa, sb = F.col("a.process_status"), F.col("b.process_status")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    changed = both & sa.isNotNull() & sb.isNotNull() & (sa != sb)
    ranked = changed & sa.isin(*STATUS_ORDER)
    ahead = ranked & ((_order(sb) > _order(sa)) | sb.isin(*TERMINAL))
    ordered = ranked & (sb.isin(*STATUS_ORDER) | sb.isin(*TERMINAL))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    one = p.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("rows_b"),
        count(F.col("a").isNotNull()).alias("unique_a"),
        count(F.col("b").isNotNull()).alias("unique_b"),
        count(both).alias("shared"),
        count(F.col("a").isNull()).alias("new"),
        count(F.col("b").isNull()).alias("gone"),
        count(changed).alias("status_changes"),
        count(F.col("a").isNull() & sb.isin(*TERMINAL)).alias("new_closed"),
        count(F.col("b").isNull() & sa.isin(*[s for s in STATUS_ORDER if s != "CONNECTED"])).alias("gone_active"),
        count(ranked & (_order(sb) < _order(sa))).alias("backward"),
        F.coalesce(F.sum(F.when(F.col("n_a") > 1, F.col("n_a"))), F.lit(0)).alias("collision_rows_a"),
        F.coalesce(F.sum(F.when(F.col("n_b") > 1, F.col("n_b"))), F.lit(0)).alias("collision_rows_b"),
        count(ahead).alias("_tl_ahead"),
        count(ordered).alias("_tl_ordered"),
    )
    return one.withColumn("forward_share", F.try_divide("_tl_ahead", "_tl_ordered")).withColumn("is_monotone", (F.col("backward") == 0) & (F.col("gone_active") == 0)).drop("_tl_ahead", "_tl_ordered")


def transitions(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY) -> DataFrame:
    """status_a, status_b, n, and the direction of the step."""
    p = pairs(a, b, fields, keep=("process_status",)).select(F.col("a.process_status").alias("status_a"), F.col("b.process_status").alias("status_b")).where("status_a IS NOT NULL AND status_b IS NOT NULL")
    oa, ob = _order(F.col("status_a")), _order(F.col("status_b"))
    kind = F.when(F.col("status_a") == F.col("status_b"), "same").when(oa.isNotNull() & ((ob > oa) | F.col("status_b").isin(*TERMINAL)), "forward").when(oa.isNotNull() & (ob < oa), "backward").otherwise("unordered")
    return p.groupBy("status_a", "status_b").agg(F.count(F.lit(1)).alias("n")).withColumn("direction", kind)


def _apart(x: Column, y: Column) -> Column:
    return (x != "") & (y != "") & ~F.contains(y, x) & ~F.contains(x, y)


def _shared(a: DataFrame, b: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    return pairs(a, b, fields, keep=keep).where("a IS NOT NULL AND b IS NOT NULL")


def linkage_audit(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY) -> DataFrame:
    """One row: pairs, confirmed, uncertain, false, and the bounds of the precision."""
    p = _shared(a, b, fields, IDENTITY)
    wrong = [_apart(core_name(F.col(f"a.{c}")), core_name(F.col(f"b.{c}"))) if c in a.columns and c in b.columns else F.lit(False) for c in IDENTITY]
    n = wrong[0].cast("int") + wrong[1].cast("int")
    one = p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(n == 0).alias("confirmed"), F.count_if(n == 1).alias("uncertain"), F.count_if(n == 2).alias("false_matches"))
    return one.withColumns({"precision_lower": F.try_divide("confirmed", "pairs"), "precision_upper": F.try_divide(F.col("confirmed") + F.col("uncertain"), F.col("pairs"))})


def linkage_discrepancies(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY, held_out: tuple[str, ...] = HELD_OUT) -> DataFrame:
    """field, category, n over the pairs, for fields outside the key."""
    own = [c for c in held_out if c in a.columns and c in b.columns]
    norm = lambda c: F.upper(strip(F.regexp_replace(_text(F.col(c)), r"(?U)\s+", " ")))
    each = _shared(a, b, fields, tuple(own)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), norm(f"a.{c}").alias("x"), norm(f"b.{c}").alias("y")) for c in own])).alias("d")).select("d.*").where("x <> y")
    cx, cy = core_name(F.col("x")), core_name(F.col("y"))
    category = F.when((F.col("x") == "") | (F.col("y") == ""), "one_sided_supplement").when(cx == cy, "alternate_spelling_same_name").when(F.contains(cy, cx) | F.contains(cx, cy), "name_extended_or_short").otherwise("content_conflict")
    return each.groupBy("field", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def recovered(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY, identity: tuple[str, ...] = IDENTITY, exclude_blank: bool = False) -> DataFrame:
    """Rows whose keys do not match but whose identity is unique on both sides: identity, status_a, status_b, and which key fields differ. A blank identity of two fields counts as one, unless it is excluded."""
    have = [c for c in identity if c in a.columns and c in b.columns]
    ka, kb = with_key(a, fields), with_key(b, fields)
    name = F.concat_ws("|", *[F.upper(strip(_text(F.col(c)))) for c in have])
    blank = "|" * (len(have) - 1) if exclude_blank else "||"
    used = [c for c in fields if c in a.columns and c in b.columns]
    keep = list(dict.fromkeys([*used, "process_status"]))

    def rest(df: DataFrame, other: DataFrame, s: str) -> DataFrame:
        left = df.select("key", name.alias("identity"), *keep).join(other.select("key").distinct(), "key", "left_anti")
        single = left.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*keep)).alias(s))
        return single.where((F.col("n") == 1) & (F.col("identity") != blank)).drop("n")

    both = rest(ka, kb, "a").join(rest(kb, ka, "b"), "identity")
    differ = F.concat_ws(";", *[F.when(_text(F.col(f"a.{c}")) != _text(F.col(f"b.{c}")), F.lit(c)) for c in used])
    return both.select("identity", F.col("a.process_status").alias("status_a"), F.col("b.process_status").alias("status_b"), differ.alias("different_key_fields"))


def linkage_recall(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = KEY, identity: tuple[str, ...] = IDENTITY, exclude_blank: bool = False) -> DataFrame:
    """One row: unique keys of both, matched, recovered and the sensitivity of the key."""
    keys = pairs(a, b, fields, keep=()).agg(F.count("a").alias("unique_a"), F.count("b").alias("unique_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"))
    n = recovered(a, b, fields, identity, exclude_blank).agg(F.count(F.lit(1)).alias("recovered"))
    return keys.crossJoin(n).withColumn("sensitivity", F.try_divide(F.col("matched"), F.col("matched") + F.col("recovered")))


def split_editions(df: DataFrame) -> DataFrame:
    """df with edition: the application rows' dates; node rows take the nearest, the later on a tie; rows without a date the last one. Null unless there are one publisher and two dates.

    The dates of a register's editions are few (one a quarter), so they travel as one array.
    """
    app = F.coalesce(F.upper("_entity"), F.lit("APPLICATION")) != "NODE" if "_entity" in df.columns else F.lit(True)
    one = df.agg(F.array_sort(F.collect_set(F.when(app, F.col("date_published")))).alias("_tl_dates"), F.count_distinct("publisher").alias("_tl_publishers"))
    out = df.crossJoin(F.broadcast(one))
    near = F.array_min(F.transform("_tl_dates", lambda d: F.struct(F.abs(F.datediff(d, F.col("date_published"))).alias("far"), (-F.unix_date(d)).alias("late"), d.alias("d"))))
    edition = F.when(F.col("date_published").isNull(), F.element_at("_tl_dates", -1)).otherwise(near["d"])
    return out.withColumn("edition", F.when((F.col("_tl_publishers") == 1) & (F.size("_tl_dates") >= 2), edition)).drop("_tl_dates", "_tl_publishers")


