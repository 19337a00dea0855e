"""Eight quality rules and the column-shift audit. A violation is a count, never an exception."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import CLASSES, STATUSES, is_nullish
from .panel import CORE, FIELDS, core_complete, entity, filled

ORDER = ("date_application", "date_conditions", "date_agreement", "date_energisation")
DATES = (*ORDER[:2], "date_refusal", *ORDER[2:])
CAPACITIES = ("capacity_injected", "capacity_withdrawn", "capacity_available", "capacity_reserved")
LEAST_KW, MOST_KW = 1.0, 5_000_000.0

# Which dates a status requires and which it rules out.
REQUIRES = {
    "CONDITIONS_ISSUED": (("date_conditions",), ("date_refusal",)),
    "REFUSED": (("date_refusal",), ("date_agreement", "date_energisation")),
    "AGREEMENT_IN_FORCE": (("date_agreement",), ("date_refusal",)),
    "CONNECTED": (("date_energisation",), ("date_refusal",)),
    "APPLICATION_FILED": ((), ("date_agreement", "date_energisation")),
    "UNDER_REVIEW": ((), ("date_agreement", "date_energisation")),
    "APPLICATION_INCOMPLETE": ((), ("date_agreement", "date_energisation")),
}


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def _day(c: str) -> Column:
    """A date column, or a text that is a whole ISO date."""
    text = F.col(c).cast("string")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def _limit() -> Column:
    return F.add_months(_day("date_conditions"), 24)


def late_expiry(df: DataFrame) -> Column:
    return F.coalesce(_day("_date_expiry") > _limit(), F.lit(False)) if {"_date_expiry", "date_conditions"} <= set(df.columns) else F.lit(False)


def late_agreement(df: DataFrame) -> Column:
    return F.coalesce(_day("date_agreement") > _limit(), F.lit(False)) if {"date_agreement", "date_conditions"} <= set(df.columns) else F.lit(False)


def r1(df: DataFrame) -> Column:
    have = [c for c in ORDER if c in df.columns]
    return _any([_day(a) > _day(b) for a, b in zip(have, have[1:], strict=False)]).cast("long")


def r2(df: DataFrame) -> Column:
    """A row counts once for a late expiry and once more for a late agreement."""
    return late_expiry(df).cast("long") + late_agreement(df).cast("long")


def r4(df: DataFrame) -> Column:
    return _any([(F.col(c) != 0) & ((F.col(c) < LEAST_KW) | (F.col(c) > MOST_KW)) for c in CAPACITIES if c in df.columns]).cast("long")


def r5(df: DataFrame) -> Column:
    days = [~_day(c).between("1990-01-01", "2100-01-01") for c in df.columns if c.startswith(("date_", "_date_"))]
    return _any(days + [F.col(c) < 0 for c in df.columns if c.startswith("capacity_")]).cast("long")


def r7(df: DataFrame) -> Column:
    return (~core_complete(df)).cast("long")


def r8(df: DataFrame) -> Column:
    return _any([filled(df, c) & ~F.coalesce(F.col(c).isin(*words), F.lit(False)) for c, words in (("resource_class", CLASSES), ("process_status", STATUSES)) if c in df.columns]).cast("long")


@dataclass(frozen=True)
class Rule:
    """A rule over single rows: violations(df) is a count for each row."""

    code: str
    name: str
    violations: Callable[[DataFrame], Column]


ROW_RULES = (
    Rule("R1", "dates in order", r1),
    Rule("R2", "two years of validity", r2),
    Rule("R4", "plausible capacity", r4),
    Rule("R5", "values in range", r5),
    Rule("R7", "complete core", r7),
    Rule("R8", "controlled vocabulary", r8),
)


def _with_shown(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """df with what its publisher discloses, and by date column whether it does; rows without a publisher see the panel's."""
    have = [c for c in DATES if c in df.columns]
    shown = [F.max(filled(df, c)).alias(f"_tl_{c}") for c in have]
    known = {c: F.col(f"_tl_{c}") for c in have}
    if "publisher" not in df.columns:
        return df.crossJoin(F.broadcast(df.agg(F.lit(1).alias("_tl_one"), *shown))), known  # one row
    table = df.rollup("publisher").agg(F.grouping_id().alias("_tl_all"), *shown).where("_tl_all = 1 OR publisher IS NOT NULL").withColumnRenamed("publisher", "_tl_publisher")
    # one row a publisher: AQE broadcasts it where it is small
    return df.join(table, F.col("publisher").eqNullSafe(F.col("_tl_publisher")), "left"), known


def _status_faults(df: DataFrame, known: dict[str, Column]) -> list[tuple[str, str, str, Column]]:
    """status, fault, date column, and where it holds of rows with that status."""
    faults = []
    for status, (required, forbidden) in REQUIRES.items():
        faults += [(status, "missing", c, known[c] & ~filled(df, c)) for c in required if c in known]
        faults += [(status, "unexpected", c, filled(df, c)) for c in forbidden if c in known]
    return faults


def r3_rows(df: DataFrame) -> DataFrame:
    """df with _tl_r3: 1 where the dates contradict the status. A date is required only of publishers that disclose it at all; without a publisher, of the panel."""
    out, known = _with_shown(df)
    bad = _any([(F.col("process_status") == status) & wrong for status, _, _, wrong in _status_faults(df, known)])
    return out.select(*df.columns, bad.cast("long").alias("_tl_r3"))


def r3_details(df: DataFrame, most: int = 20) -> DataFrame:
    """status, fault (missing or unexpected), field, n: the most frequent contradictions of dates and status, ties by name."""
    out, known = _with_shown(df)
    faults = _status_faults(df, known)
    sums = out.agg(*[F.count_if((F.col("process_status") == status) & wrong).alias(f"_tl_{i}") for i, (status, _, _, wrong) in enumerate(faults)], F.lit(0).alias("_tl_none"))
    rows = [F.struct(F.lit(status).alias("status"), F.lit(fault).alias("fault"), F.lit(c).alias("field"), F.col(f"_tl_{i}").alias("n")) for i, (status, fault, c, _) in enumerate(faults)]
    empty = F.array().cast("array<struct<status:string,fault:string,field:string,n:bigint>>")
    return sums.select(F.explode(F.array(*rows) if rows else empty).alias("r")).select("r.*").where("n > 0").orderBy(F.desc("n"), "status", "fault", "field").limit(most)


def r7_details(df: DataFrame) -> DataFrame:
    """entity, field, n: rows of each entity that lack a required field, or all fields of a group of which one is required."""
    lacks = []
    for name, (required, alternatives) in CORE.items():
        lacks += [(name, c, ~filled(df, c)) for c in required]
        lacks += [(name, "at least one of: " + ", ".join(group), ~_any([filled(df, c) for c in group])) for group in alternatives]
    sums = df.agg(*[F.count_if((entity(df) == name) & lack).alias(f"_tl_{i}") for i, (name, _, lack) in enumerate(lacks)])
    rows = [F.struct(F.lit(name).alias("entity"), F.lit(label).alias("field"), F.col(f"_tl_{i}").alias("n")) for i, (name, label, _) in enumerate(lacks)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0")


def entity_rows(df: DataFrame) -> DataFrame:
    """entity, n, incomplete: rows of each entity, and of them those that lack what R7 asks of it."""
    return df.groupBy(entity(df).alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~core_complete(df)).alias("incomplete"))


def duplicates(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rule R6: surplus rows of identifiers that repeat; a dash is an identifier, null is none."""
    by = by or []
    counts = df.where("application_id IS NOT NULL").groupBy(*by, "application_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"),
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.coalesce(F.max(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("max_multiplicity"),
    )


def _unreadable(df: DataFrame) -> dict[str, Column]:
    """By numeric field that is text in df, the values that are no numbers."""
    texts = [f.name for f in FIELDS if f.dtype == "number" and f.name in df.columns and isinstance(df.schema[f.name].dataType, T.StringType)]
    return {c: ~is_nullish(F.col(c)) & F.col(c).try_cast("double").isNull() for c in texts}


def _alone(df: DataFrame, rule: Rule, texts: list[str]) -> tuple[Column | None, list[str], str | None]:
    """The rule's column, which of the text fields it takes for numbers, or what is wrong with it: it is analysed alone, so that it cannot break the plan of the others."""
    try:
        column = rule.violations(df)
        plan = df.select(column)._jdf.queryExecution().analyzed().toString()
    except Exception as wrong:  # a rule must not break the report
        return None, [], _said(wrong)
    return column, [c for c in texts if re.search(rf"cast\({re.escape(c)}#\d+ as (double|float|decimal|big|int)", plan)], None


def _said(wrong: Exception) -> str:
    return f"{type(wrong).__name__}: {str(wrong).splitlines()[0] if str(wrong) else ''}"


def _measures(df: DataFrame, rules: tuple[Rule, ...], only: tuple[str, ...] | None) -> tuple[DataFrame, list[Column], dict[str, Column], dict[str, Column]]:
    """The frame to scan, its aggregates (n, a sum for each rule, unreadable values by field), and by rule its violations and its error over them."""
    wanted = lambda code: only is None or code in only
    bad = _unreadable(df)
    checked = {r.code: (r, *_alone(df, r, list(bad))) for r in rules if wanted(r.code)}
    # rules that take no text for a number see the texts themselves; the others a frame in which what is no number is null
    frame = df.withColumns({f"_tl_v_{code}": column for code, (_, column, reads, wrong) in checked.items() if not (reads or wrong)} | {f"_tl_bad_{c}": b for c, b in bad.items()})
    typed = frame.withColumns({c: F.col(c).try_cast("double") for c in bad})
    late = {f"_tl_v_{code}": r.violations(typed) for code, (r, _, reads, _) in checked.items() if reads}
    frame, wrong_r3 = typed.withColumns(late), None
    if wanted("R3") and "process_status" in df.columns:
        try:
            frame = r3_rows(frame)
        except Exception as wrong:  # as for every rule
            wrong_r3 = _said(wrong)
    if "_tl_r3" not in frame.columns:
        frame = frame.withColumn("_tl_r3", F.lit(0))
    if wanted("R3"):
        checked["R3"] = (None, F.col("_tl_r3"), [], wrong_r3)
    sums, violations, errors = [F.count(F.lit(1)).alias("n")] + [F.count_if(f"_tl_bad_{c}").alias(f"_tl_bad_{c}") for c in bad], {}, {}
    for code, (_, _, reads, wrong) in checked.items():
        if wrong:
            violations[code], errors[code] = F.lit(-1).cast("long"), F.lit(wrong)
            continue
        sums.append(F.coalesce(F.sum("_tl_r3" if code == "R3" else f"_tl_v_{code}"), F.lit(0)).cast("long").alias(code))
        said = [F.when(F.col(f"_tl_bad_{c}") > 0, F.concat(F.col(f"_tl_bad_{c}").cast("string"), F.lit(f" values of {c} are no numbers"))) for c in reads]
        wrong = F.nullif(F.array_join(F.array_compact(F.array(*said)), "; "), F.lit("")) if said else F.lit(None).cast("string")
        violations[code], errors[code] = F.when(wrong.isNotNull(), F.lit(-1)).otherwise(F.col(code)).cast("long"), wrong
    return frame, sums, violations, errors


def run_quality(df: DataFrame, rules: tuple[Rule, ...] = ROW_RULES, only: tuple[str, ...] | None = None) -> DataFrame:
    """code, violations, share, error of all rules, or of those named by only. The row rules and R3 share one scan; R6 groups by the identifier.

    Rules are isolated: one that cannot be analysed (a column is missing, types do not fit), or that reads a numeric field
    with values that are no numbers, has -1 violations, no share and its error; the others have their counts.
    """
    frame, sums, violations, errors = _measures(df, rules, only)
    one = frame.agg(*sums)
    each = [F.struct(F.lit(c).alias("code"), v.alias("violations"), errors[c].alias("error")) for c, v in violations.items()]
    empty = F.array().cast("array<struct<code:string,violations:bigint,error:string>>")
    long = one.select("n", F.explode(F.array(*each) if each else empty).alias("r")).select("n", "r.*")
    if (only is None or "R6" in only) and "application_id" in df.columns:
        # rows without an identifier count for the share only
        ids = df.groupBy("application_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("application_id").isNotNull(), F.col("c") - 1)), F.lit(0)).alias("violations"))
        long = long.unionByName(ids.select("n", F.lit("R6").alias("code"), "violations", F.lit(None).cast("string").alias("error")))
    return long.select("code", "violations", F.when(F.col("violations") >= 0, F.bround(F.try_divide("violations", "n"), 6)).alias("share"), "error")


def quality_report(df: DataFrame, rules: tuple[Rule, ...] = ROW_RULES) -> dict:
    """n_rows, rules (as run_quality gives them) and violations_total, at once. If a rule fails while the scan runs, each row rule is run alone, so that only the failing ones have -1.

    The counts of the scan are observed metrics of a job that writes nothing. The total adds violations as they are, so a failed rule takes one away.
    """
    names = {r.code: r for r in rules}
    try:
        rows = [r.asDict() for r in run_quality(df, rules).collect()]
        n = _observed(df)
    except Exception:  # only which rule it was is still to be found
        n, rows = _observed(df), []
        for code in (*names, "R3", "R6"):
            try:
                rows += [r.asDict() for r in run_quality(df, tuple(r for r in rules if r.code == code), only=(code,)).collect()]
            except Exception as wrong:
                rows.append({"code": code, "violations": -1, "share": None, "error": _said(wrong)})
    return {"n_rows": n, "rules": rows, "violations_total": sum(r["violations"] for r in rows)}


def _observed(df: DataFrame) -> int:
    seen = Observation()
    df.select(F.lit(1)).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def quality_sums(df: DataFrame, rules: tuple[Rule, ...] = ROW_RULES) -> DataFrame:
    """publisher, is_total, n, code, violations: every rule of each publisher and of the panel, in one grouping-sets plan.

    R6 starts from the counts of (publisher, identifier): those of a publisher are its own, and their sums by identifier
    are the panel's. Rows without a publisher count for the panel only.
    """
    scanned = r3_rows(df)
    codes = [*(r.code for r in rules), "R3"]
    sums = scanned.groupingSets([["publisher"], []], "publisher").agg(F.grouping("publisher").alias("g"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_tl_r3"), F.lit(0)).alias("R3"), *[F.coalesce(F.sum(r.violations(df)), F.lit(0)).alias(r.code) for r in rules])
    sums = sums.where("g = 1 OR publisher IS NOT NULL")
    parts = df.where("application_id IS NOT NULL").groupBy("publisher", "application_id").agg(F.count(F.lit(1)).alias("c"))
    # an identifier's counts meet in its own group, whichever publishers they come from
    merged = parts.groupBy("application_id").agg(F.sum("c").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("v"))
    own = parts.where("publisher IS NOT NULL").groupBy("publisher").agg(F.sum(F.col("c") - 1).alias("v"))
    r6 = own.select(F.col("publisher"), F.lit(0).alias("g"), "v").unionAll(merged.select(F.lit(None).cast("string"), F.lit(1), "v"))
    both = sums.join(r6.select(F.col("publisher").alias("p6"), F.col("g").alias("g6"), F.col("v").alias("R6")), (F.col("g") == F.col("g6")) & F.col("publisher").eqNullSafe(F.col("p6")), "left")
    each = F.array(*[F.struct(F.lit(c).alias("code"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("violations")) for c in (*codes, "R6")])
    return both.select("publisher", (F.col("g") == 1).alias("is_total"), "n", F.explode(each).alias("r")).select("publisher", "is_total", "n", "r.*")


def sum_check(df: DataFrame, rules: tuple[Rule, ...] = ROW_RULES) -> DataFrame:
    """One row: n_rows, n_publishers, violations_total of the panel, and mismatch: the rules whose sum over publishers is not the panel's, as "code:sum/panel", joined by commas (empty if none)."""
    by_code = quality_sums(df, rules).groupBy("code").agg(F.max(F.when(F.col("is_total"), F.col("n"))).alias("n"), F.count_if(~F.col("is_total")).alias("p"), F.sum(F.when(F.col("is_total"), F.col("violations"))).alias("panel"), F.coalesce(F.sum(F.when(~F.col("is_total"), F.col("violations"))), F.lit(0)).alias("parts"))
    said = F.when(F.col("panel") != F.col("parts"), F.format_string("%s:%d/%d", "code", "parts", "panel"))
    return by_code.agg(F.max("n").alias("n_rows"), F.max("p").alias("n_publishers"), F.sum("panel").alias("violations_total"), F.array_join(F.array_sort(F.collect_list(said)), ",").alias("mismatch"))


def quality_by_publisher(df: DataFrame, rules: tuple[Rule, ...] = ROW_RULES) -> DataFrame:
    """publisher, code, violations. R3 keeps each publisher's own disclosed dates; R6 counts within the publisher."""
    sums = r3_rows(df).groupBy("publisher").agg(F.sum("_tl_r3").alias("R3"), *[F.sum(r.violations(df)).alias(r.code) for r in rules])
    codes = [*(r.code for r in rules), "R3"]
    long = sums.select("publisher", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("long").alias("violations")) for c in codes])).alias("r")).select("publisher", "r.code", "r.violations")
    return long.unionByName(duplicates(df, ["publisher"]).select("publisher", F.lit("R6").alias("code"), "violations"))


def surplus_days(df: DataFrame) -> DataFrame:
    """Of late expiries: how many, the upper median, least and most days over the limit, and how many beyond 30."""
    days = df.where(late_expiry(df)).select(F.datediff(_day("_date_expiry"), _limit()).alias("d"))
    # the upper median of n values is the one at rank n / 2, counted from 0: a running count over distinct values
    counts = days.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.min("d").alias("least"), F.max("d").alias("most"), F.sum(F.when(F.col("d") > 30, F.col("n")).otherwise(0)).alias("beyond_30"))
    from pyspark.sql import Window

    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("d")))
    median = ranked.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("d").alias("median"))
    return total.crossJoin(median).select(F.col("total").alias("n"), "median", "least", "most", "beyond_30")


# What a value of each field looks like, for the shift audit.
def looks_like_date(c: Column) -> Column:
    return c.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$|^\d{4}-\d{1,2}-\d{1,2}$")


def looks_like_number(c: Column) -> Column:
    return c.rlike(r"^[+-]?\d[\d  ]*([.,]\d+)?$")


def looks_like_text(c: Column) -> Column:
    return ~looks_like_number(c) & ~looks_like_date(c) & ~c.rlike(r"^\d+([.,]\d+)?\s")


PREDICATES: dict[str, Callable[[Column], Column]] = {
    **{c: looks_like_date for c in DATES},
    **{c: looks_like_number for c in CAPACITIES},
    "resource_class": looks_like_text,
    "process_status": looks_like_text,
    "voltage_level": lambda c: c.rlike(r"(?i)^(\d+([.,]\d+)?\s*kv|sn|wn|nn)"),
}


def column_shift(df: DataFrame, predicates: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """field, rows whose value does not belong there; the row without a field counts rows with any."""
    own = {c: p for c, p in (predicates or PREDICATES).items() if c in df.columns}
    bad = {c: ~is_nullish(F.col(c), "shift") & ~F.coalesce(p(F.col(c).cast("string")), F.lit(False)) for c, p in own.items()}
    sums = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()], F.count_if(_any(list(bad.values()))).alias("_tl_any"))
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).alias("rows")) for c in own] + [F.struct(F.lit(None).cast("string").alias("field"), F.col("_tl_any").alias("rows"))]
    return sums.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", "p.rows")


def shifted_rows(df: DataFrame, order: str, most: int = 5, predicates: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """order, fields: the first rows by the column order with a value that does not belong, and the fields where."""
    own = {c: p for c, p in (predicates or PREDICATES).items() if c in df.columns}
    bad = [F.when(~is_nullish(F.col(c), "shift") & ~F.coalesce(p(F.col(c).cast("string")), F.lit(False)), F.lit(c)) for c, p in own.items()]
    fields = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.select(order, fields.alias("fields")).where("size(fields) > 0").orderBy(order).limit(most)
