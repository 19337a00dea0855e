"""The nine publishers: from a document, or its staged words, to the panel, each as one plan.

Exports are read by Spark's CSV reader, workbooks by the data source of workbook.py. A printed document comes staged, as
a folder of two Parquet tables that any PDF tool can fill: words (document, page, text, x0, x1, top) and edges (document,
page, x0, top, bottom: vertical lines). Pages and documents are keys of grouped plans; nothing is read on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import both_known_or, components_mw, harmonize_class, harmonize_status, is_nullish, iso_date, norm_text, number, power_kw, split_sum_kw, strip, voltage_levels
from ..functions.documents import as_at, date_in_name, stated_kva, voltage_tag, written_date
from ..functions.tables import written
from ..operators import layout
from ..operators.panel import FIELDS, finalize, union_panels
from . import registers, workbook

PAGE = ("document", "page")

# ---------------------------------------------------------------- the common template

# The logical columns of the common template of applications, in order.
TEMPLATE = (
    "item_no", "object_id", "object_name", "osd_osp", "applicant", "location", "voltage_level", "multiple_places", "kind", "capacity_injected", "capacity_withdrawn",
    "mz_pv", "mz_fw", "mz_mee_discharging", "mz_mee_charging", "mz_odb", "mz_other", "status", "date_submission", "date_advance_payment", "date_conditions", "date_refusal",
    "refusal_justification", "date_expiry", "date_agreement", "date_energisation", "date_contract_termination", "date_contract_expiration", "notes",
)
#: The columns of the workbook (no number, no notes) and of the printed listing (no name), as they stand.
WORKBOOK_COLUMNS = TEMPLATE[1:-1]
PRINTED_COLUMNS = tuple(c for c in TEMPLATE if c != "object_name")
# Extensions of the template by their logical column: texts, dates, installed capacities.
TEMPLATE_TEXTS = {"_applicant": "applicant", "_dso_tso": "osd_osp", "_facility_name": "object_name", "_multiple_points": "multiple_places", "_kind_raw": "kind", "_status_raw": "status", "_remarks": "notes", "_document_item_no": "item_no"}
TEMPLATE_DATES = {"_date_advance_payment": "date_advance_payment", "_date_expiry": "date_expiry", "_date_agreement_termination": "date_contract_termination", "_date_agreement_lapse": "date_contract_expiration"}
TEMPLATE_KW = {"_ic_pv": "mz_pv", "_ic_wind": "mz_fw", "_ic_storage_discharging": "mz_mee_discharging", "_ic_storage_charging": "mz_mee_charging", "_ic_load": "mz_odb", "_ic_other": "mz_other"}


def _clean(c: Column) -> Column:
    """Single spaces; what stands for nothing is null."""
    text = strip(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))
    return F.when(~is_nullish(text, "cell"), text)


def _filled(c: Column) -> Column:
    """Single spaces; empty is null."""
    return F.nullif(strip(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")), F.lit(""))


def template_columns(raw: DataFrame, key: str, order: list[str]) -> list[Column]:
    """The panel's columns of a frame in the template's logical columns (texts; missing ones are null), capacities in MW. An entry without an id is named by its number, or by its place among the document's rows in the order given."""
    col = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    place = F.row_number().over(Window.partitionBy("document").orderBy(*order)).cast("string")
    item = F.rtrim(_clean(col("item_no")), F.lit("."))
    said = _clean(col("date_energisation"))
    return [
        F.coalesce(_clean(col("object_id")), F.concat(F.lit(f"{key}:poz:"), F.coalesce(item, place))).alias("application_id"),
        _clean(col("location")).alias("location_text"),
        voltage_levels(_clean(col("voltage_level"))).alias("voltage_level"),
        harmonize_class(_clean(col("kind"))).alias("resource_class"),
        split_sum_kw(col("capacity_injected")).alias("capacity_injected"),
        split_sum_kw(col("capacity_withdrawn")).alias("capacity_withdrawn"),
        harmonize_status(_clean(col("status"))).alias("process_status"),
        iso_date(col("date_submission")).alias("date_application"),
        *[iso_date(col(c)).alias(c) for c in ("date_conditions", "date_refusal", "date_agreement", "date_energisation")],
        _clean(col("refusal_justification")).alias("refusal_reason"),
        F.when(iso_date(said).isNull(), said).alias("_energisation_text"),
        F.lit("APPLICATION").alias("_entity"),
        *[_clean(col(c)).alias(to) for to, c in TEMPLATE_TEXTS.items()],
        *[iso_date(col(c)).alias(to) for to, c in TEMPLATE_DATES.items()],
        *[split_sum_kw(col(c)).alias(to) for to, c in TEMPLATE_KW.items()],
        *[components_mw(col(c)).alias(f"_{c}_components_mw") for c in ("capacity_injected", "capacity_withdrawn")],
    ]


# ---------------------------------------------------------------- printed documents


def staged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/words.parquet"), spark.read.parquet(f"{path}/edges.parquet")


def page_lines(words: DataFrame, tol: float = 2.0) -> DataFrame:
    """document, page, line, text of the staged words, from top to bottom."""
    return layout.line_words(words, tol, PAGE).select(*PAGE, "line", said(F.col("words")).alias("text"))


def said(words: Column) -> Column:
    """The text of a line's words."""
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def page_texts(words: DataFrame, tol: float = 2.0) -> DataFrame:
    """document, page, text: a page's lines."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return page_lines(words, tol).groupBy(*PAGE).agg(joined.alias("text"))


def stated_dates(texts: DataFrame, date: Callable[[Column], Column]) -> DataFrame:
    """document, date_published: the date that the first page with one states; null if none does."""
    day = date(F.col("text"))
    return texts.groupBy("document").agg(F.min_by(day, F.when(day.isNotNull(), F.col("page"))).alias("date_published"))


def ruled_records(words: DataFrame, edges: DataFrame, start: str, least: int = 2, joiner: str = "\n", dates: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """document, page, record, line, cells: the records of ruled pages with at least so many columns. A record begins with a line whose first cell matches start; record 0 is what stands above the first. With dates (document, date_published), each record has its document's; they are joined to the pages, which are far fewer. tasks: layout.sorted_tasks of the words, if known."""
    tasks = tasks or layout.sorted_tasks(words)
    bounds = layout.ruled_bounds(edges.repartition(tasks, *PAGE), keys=PAGE).where(F.size("bounds") > least)
    return layout.table_records(words, bounds if dates is None else _stamped(bounds, dates), F.trim(F.col("cells")[0]).rlike(start), keys=PAGE, joiner=joiner, tasks=tasks)


def named(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Records with their cells as columns: missing ones are empty, surplus ones are left out. _seq is their order in the document."""
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)]
    dates = [c for c in records.columns if c == "date_published"]
    return records.select("document", (F.col("page").cast("long") * 1_000_000 + F.col("record")).alias("_seq"), *cells, *dates)


NUMBERED = r"^\d+\.?$"


def _stamped(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(dates.hint("merge"), "document", "left")  # documents are as many as the input has: never broadcast


def _out(raw: DataFrame, columns: list[Column], key: str) -> DataFrame:
    p = PUBLISHERS[key]
    keep = [F.col("document").alias("source_document"), F.col("_seq"), *([F.col("date_published")] if "date_published" in raw.columns else [])]
    return finalize(raw.select(*columns, *keep), p.name, p.jurisdiction)


# The columns of the ruled list of 27.
STATION_LIST = (
    "item_no", "object_id", "osd_name", "entity_kind", "station_location", "voltage_level", "multiple_places", "kind", "capacity_injected", "capacity_withdrawn",
    "mz_pv", "mz_fw", "mz_mee_discharging", "mz_mee_charging", "mz_odb", "mz_other", "status", "date_submission", "date_advance_payment", "date_conditions", "date_refusal",
    "refusal_justification", "date_expiry", "date_agreement", "date_energisation", "date_contract_termination", "date_contract_expiration",
)


def station_list(words: DataFrame, edges: DataFrame) -> DataFrame:
    """A ruled list whose places are codes of stations; its legend stands on pages without rules (see layout.legend)."""
    dates = stated_dates(page_texts(words.where("page = 1")), as_at)
    raw = named(ruled_records(words, edges, r"^\d+$", dates=dates).where("record > 0"), STATION_LIST)
    kw = lambda c: power_kw(_filled(F.col(c)), "MW")
    day = lambda c: iso_date(_filled(F.col(c)))
    installed = [kw(c) for c in TEMPLATE_KW.values()]
    known = reduce(lambda a, b: a | b, [c.isNotNull() for c in installed])
    columns = [
        _filled(F.col("object_id")).alias("application_id"), _filled(F.col("station_location")).alias("node_id"), _filled(F.col("station_location")).alias("location_text"), _filled(F.col("voltage_level")).alias("voltage_level"),
        harmonize_class(_filled(F.col("kind"))).alias("resource_class"), kw("capacity_injected").alias("capacity_injected"), kw("capacity_withdrawn").alias("capacity_withdrawn"), harmonize_status(_filled(F.col("status"))).alias("process_status"),
        day("date_submission").alias("date_application"), *[day(c).alias(c) for c in ("date_conditions", "date_refusal", "date_agreement", "date_energisation")], _filled(F.col("refusal_justification")).alias("refusal_reason"),
        *[day(c).alias(to) for to, c in {"_date_advance_payment": "date_advance_payment", "_date_expiry": "date_expiry", "_date_termination": "date_contract_termination", "_date_lapse": "date_contract_expiration"}.items()],
        *[_filled(F.col(c)).alias(to) for to, c in {"_multiple_points": "multiple_places", "_applicant_kind": "entity_kind", "_installation_kind_raw": "kind", "_status_raw": "status", "_document_item_no": "item_no"}.items()],
        F.when(known, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in installed])).alias("_capacity_installed_kw"),
    ]
    return _out(raw, columns, "pl_tauron")


def printed_template(words: DataFrame, edges: DataFrame, key: str = "pl_energa", tasks: int | None = None) -> DataFrame:
    """The common template as a ruled list of 28 columns."""
    dates = stated_dates(page_texts(words), as_at)
    raw = named(ruled_records(words, edges, NUMBERED, 10, dates=dates, tasks=tasks).where("record > 0"), PRINTED_COLUMNS)
    return _out(raw, template_columns(raw, key.split("_")[1], ["_seq"]), key)


# The years of the horizon.
HORIZON = ("2026", "2027", "2028", "2029", "2030", "2031", "2035")


def group_capacities(words: DataFrame, edges: DataFrame, base_year: str = HORIZON[0], tasks: int | None = None) -> DataFrame:
    """Groups of nodes from three tables, told by the captions of their pages: 2.1 (composition; a row that names a branch holds for those below, also on later pages), 2.3 and 2.4 (values by year; a row of three years or more names a page's columns)."""
    texts = page_texts(words)
    caption = F.array_join(F.filter(F.slice(F.split("text", "\n"), 1, 6), lambda x: F.startswith(F.trim(x), F.lit("Tabela"))), " ")
    pages = texts.select(*PAGE, F.regexp_extract(norm_text(caption), r"^tabela (2\.[134])", 1).alias("table"), norm_text(F.col("text")).alias("plain"))
    direction = pages.groupBy("document").agg(F.min_by("plain", "page").alias("first")).select("document", F.when(F.contains("first", F.lit("dostepnej odbiorczej mocy")), "demand").otherwise("generation").alias("direction"))
    # any row begins a record that has a number, a branch or years in it
    bounds = layout.ruled_bounds(edges, keys=PAGE).where(F.size("bounds") > 2)
    years = lambda cells: F.filter(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0))), lambda x: F.trim(x).rlike(r"^(19|20)\d{2}$"))
    numbered = F.trim(F.col("cells")[0]).rlike(r"^\d+$")
    branch = F.nullif(F.regexp_extract(F.array_join("cells", " "), r"Oddział\s+([\p{L}\w-]+)", 1), F.lit(""))
    records = layout.table_records(words, bounds, numbered | branch.isNotNull() | (F.size(years(F.col("cells"))) >= 3), keys=PAGE, tasks=tasks or layout.sorted_tasks(words)).join(pages.select(*PAGE, "table"), list(PAGE)).where("record > 0")
    text = lambda i: _filled(F.get("cells", F.lit(i)))
    composition = layout.carry_forward(records.where("table = '2.1'").withColumn("seq", F.struct("page", "record")), F.when(~numbered, branch), ["document"], "seq", "branch").where(numbered)
    groups = composition.groupBy("document", F.trim(F.col("cells")[0]).alias("no")).agg(F.max_by(F.struct(text(2).alias("stations"), text(3).alias("changes"), "branch"), "seq").alias("g"))
    header = F.when(F.size(years(F.col("cells"))) >= 3, F.col("cells"))
    valued = layout.carry_forward(records.where("table IN ('2.3', '2.4')"), header, list(PAGE), "record", "years").where(numbered & F.col("years").isNotNull())
    each = valued.select("document", "table", F.struct("page", "record").alias("seq"), F.trim(F.col("cells")[0]).alias("no"), text(1).alias("name"), F.posexplode("cells").alias("i", "cell"), "years").withColumn("year", F.get("years", F.col("i")))
    kw = power_kw(_filled(F.col("cell")), "MW")
    last = each.groupBy("document", "table", "no").agg(F.max("seq").alias("seq"))
    each = each.join(last, ["document", "table", "no", "seq"])  # a group told twice: the last holds
    at = lambda table, year: F.max(F.when((F.col("table") == table) & (F.col("year") == year), kw))
    wide = each.groupBy("document", "no").agg(F.max(F.when(F.col("table") == "2.3", F.struct("seq", "name"))).alias("own"), *[at("2.3", y).alias(f"_capacity_available_{y}") for y in HORIZON], at("2.3", base_year).alias("capacity_available"), at("2.4", base_year).alias("_capacity_available_analytical"))
    both = wide.where("own IS NOT NULL").join(groups, ["document", "no"], "left").join(direction, "document").withColumn("_seq", F.col("no").cast("long"))
    both = _stamped(both, stated_dates(texts, as_at))
    columns = [
        F.concat(F.lit("energa:grupa110:"), "no", F.lit(":"), "direction").alias("node_id"), F.col("own.name").alias("node_name"), F.coalesce("g.stations", "own.name").alias("location_text"), F.lit("110 kV").alias("voltage_level"),
        F.when(F.col("direction") == "demand", "LOAD").otherwise("UNSPECIFIED").alias("resource_class"), F.lit("UNSPECIFIED").alias("process_status"), "capacity_available", F.lit("NODE").alias("_entity"), F.col("direction").alias("_direction"), F.col("no").alias("_group_no"),
        F.col("g.stations").alias("_group_stations"), F.col("g.changes").alias("_changes_by_year"), F.col("g.branch").alias("_branch"), *[f"_capacity_available_{y}" for y in HORIZON], "_capacity_available_analytical",
    ]
    return _out(both, columns, "pl_energa")


def printed_energa(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents whose first page speaks of available capacity are of node groups, the others lists of applications."""
    first = page_texts(words).groupBy("document").agg(F.min_by("text", "page").alias("text"))
    nodes = first.where(norm_text(F.col("text")).rlike("dostepnej (odbiorczej|wytworczej) mocy")).select("document")
    of = lambda df, how: df.join(nodes, "document", how)
    tasks = layout.sorted_tasks(words)
    return union_panels([printed_template(of(words, "left_anti"), of(edges, "left_anti"), tasks=tasks), group_capacities(of(words, "left_semi"), of(edges, "left_semi"), tasks=tasks)])


# The columns of the three ruled listings, which share their first seven; what their headings say, most telling first.
_LISTED = ("item_no", "customer_kind", "locality", "address", "capacity_base", "capacity_reserve", "kind")
LISTINGS = {
    "refusals": (*_LISTED, "date_submission", "date_advance_payment", "refusal_reason", "date_refusal"),
    "applications": (*_LISTED, "date_submission", "date_advance_payment", "application_status"),
    "applicants": (*_LISTED, "date_conditions", "date_agreement", "date_energisation"),
}


def listing_of(heading: Column) -> Column:
    """Which of the three listings a heading is of; null if none."""
    text = norm_text(heading)
    has = lambda said: F.contains(text, F.lit(said))
    return F.when(has("odmowa przylaczenia") | has("data odmowy"), "refusals").when(has("status rozpatrywania"), "applications").when(has("data rozpoczecia") & has("data zawarcia"), "applicants")


def _reached(energisation: Column, agreement: Column, conditions: Column) -> Column:
    """The status that a row's dates tell."""
    return F.when(energisation.isNotNull(), "CONNECTED").when(agreement.isNotNull(), "AGREEMENT_IN_FORCE").when(conditions.isNotNull(), "CONDITIONS_ISSUED").otherwise("UNSPECIFIED")


def ruled_listings(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Ruled documents that each hold one of three listings, told by the heading above their first numbered row. A document with no known heading has no rows; see unknown_listings."""
    records = ruled_records(words, edges, NUMBERED)
    kinds = _listings(records)
    raw = named(records.where("record > 0"), tuple(str(i) for i in range(max(map(len, LISTINGS.values()))))).join(kinds.where("listing IS NOT NULL"), "document")
    raw = _stamped(raw, stated_dates(page_texts(words), as_at))

    def cell(name: str) -> Column:
        out = F.lit(None).cast("string")
        for kind, columns in LISTINGS.items():
            if name in columns:
                out = F.when(F.col("listing") == kind, _filled(F.col(str(columns.index(name))))).otherwise(out)
        return out

    day = lambda c: iso_date(cell(c))
    refused = F.col("listing") == "refusals"
    status = F.when(refused, "REFUSED").when(F.col("listing") == "applications", harmonize_status(cell("application_status"))).otherwise(_reached(day("date_energisation"), day("date_agreement"), day("date_conditions")))
    place = F.row_number().over(Window.partitionBy("document").orderBy("_seq")).cast("string")
    columns = [
        F.concat(F.lit("stoen:"), "listing", F.lit(":"), place).alias("application_id"), F.nullif(F.concat_ws(", ", cell("locality"), cell("address")), F.lit("")).alias("location_text"), harmonize_class(cell("kind")).alias("resource_class"),
        power_kw(cell("capacity_base"), "kW").alias("capacity_withdrawn"), power_kw(cell("capacity_reserve"), "kW").alias("capacity_reserved"), status.alias("process_status"), day("date_submission").alias("date_application"),
        *[day(c).alias(c) for c in ("date_conditions", "date_refusal", "date_agreement", "date_energisation")], cell("refusal_reason").alias("refusal_reason"), day("date_advance_payment").alias("_date_advance_payment"),
        F.coalesce(cell("application_status"), cell("refusal_reason")).alias("_status_raw"), F.col("listing").alias("_listing"),
        *[cell(c).alias(to) for to, c in {"_applicant_kind": "customer_kind", "_locality": "locality", "_address": "address", "_installation_kind_raw": "kind", "_document_item_no": "item_no"}.items()],
    ]
    return _out(raw, columns, "pl_stoen")


def _listings(records: DataFrame) -> DataFrame:
    # a heading may stand alone on a page of its own
    heading = F.when(F.col("record") == 0, F.struct("page", F.array_join("cells", " ").alias("text")))
    return records.groupBy("document").agg(F.min(heading).alias("h")).select("document", listing_of(F.col("h.text")).alias("listing"))


def unknown_listings(words: DataFrame, edges: DataFrame) -> DataFrame:
    """document: ruled documents whose heading tells none of the three listings."""
    return _listings(ruled_records(words, edges, NUMBERED)).where("listing IS NULL").select("document")


# The numbered headings of the printed sections, and the columns of those that list applications.
SECTIONS = {1: r"(?i)^1\.\s*Podmioty ubiegaj", 2: r"(?i)^2\.\s*Warto", 3: r"(?i)^3\.\s*Z[łl]o[żz]one wnioski", 4: r"(?i)^4\.\s*Wydane odmowy", 5: r"(?i)^5\.\s*Spos[óo]b"}
SECTION_COLUMNS = {
    1: ("item_no", "entity_kind", "location", "capacity", "kind", "date_conditions", "date_agreement", "date_energisation"),
    3: ("item_no", "entity_kind", "location", "capacity", "kind", "date_submission", "date_advance_payment", "application_status"),
    4: ("item_no", "location", "capacity", "kind", "date_submission", "date_advance_payment", "refusal_reason"),
}


def sectioned(words: DataFrame, tol: float = 2.5) -> DataFrame:
    """The lines (document, page, line, words, said, first) with the section whose heading came last, over all pages of a document; the headings themselves are left out."""
    heads = layout.line_words(words, tol, PAGE).withColumns({"said": said(F.col("words")), "first": F.get("words", F.lit(0))["text"]})
    opened = F.lit(None).cast("int")
    for no, rx in SECTIONS.items():
        opened = F.when(F.trim("said").rlike(rx), no).otherwise(opened)
    at = layout.carry_forward(heads.withColumns({"opened": opened, "seq": F.struct("page", "line")}), F.col("opened"), ["document"], "seq", "section")
    return at.where("opened IS NULL AND section IS NOT NULL").drop("opened", "seq")


def printed_sections(words: DataFrame) -> DataFrame:
    """Sections of unruled lists: columns are the corridors that no word of a section covers, rows begin with a numbered line, rows of nothing but placeholders are left out."""
    keys = ("document", "section")
    own = sectioned(words).where(F.col("section").isin(*SECTION_COLUMNS))
    at = F.struct("page", "line")
    start = F.min(F.when(F.col("first").rlike(r"^\d+\.$"), at)).over(Window.partitionBy(*keys))
    own = own.withColumn("_tl_from", start).where(at >= F.col("_tl_from"))
    bounds = layout.banded_bounds(own.select(*keys, F.inline("words")), 6.0, keys=keys)
    rows = layout.cell_rows(own.join(bounds.hint("merge"), list(keys)), (*keys, "page"))
    records = layout.merge_cells(rows, F.col("cells")[0].rlike(r"^\d+\.$"), keys, ("page", "line"))
    fitted = F.lit(None).cast("array<string>")
    for no, columns in SECTION_COLUMNS.items():
        fitted = F.when(F.col("section") == no, layout.fit(F.col("cells"), len(columns))).otherwise(fitted)
    raw = records.withColumn("cells", F.transform(fitted, lambda x: F.coalesce(_filled(x), F.lit(""))))
    raw = raw.where(F.exists(F.slice("cells", 2, F.size("cells") - 1), lambda x: ~norm_text(x).isin("", "brak", "-")))
    raw = raw.withColumn("_seq", F.col("section").cast("long") * 1_000_000_000 + F.col("record"))
    raw = _stamped(raw, stated_dates(page_texts(words, 2.5), lambda c: written_date(F.regexp_extract(c, r"Data aktualizacji publikacji:\s*(\d{1,2}\s+\p{L}+\s+\d{4})", 1))))

    def cell(name: str) -> Column:
        out = F.lit(None).cast("string")
        for no, columns in SECTION_COLUMNS.items():
            if name in columns:
                out = F.when(F.col("section") == no, F.nullif(F.get("cells", F.lit(columns.index(name))), F.lit(""))).otherwise(out)
        return out

    day = lambda c: iso_date(cell(c))
    section = F.col("section")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("record")).cast("string")
    columns = [
        F.concat(F.lit("boryszew:pkt"), section.cast("string"), F.lit(":"), place).alias("application_id"), cell("location").alias("location_text"), harmonize_class(cell("kind")).alias("resource_class"), power_kw(cell("capacity"), "MW").alias("capacity_withdrawn"),
        F.when(section == 4, "REFUSED").when(section == 3, harmonize_status(cell("application_status"))).otherwise(_reached(day("date_energisation"), day("date_agreement"), day("date_conditions"))).alias("process_status"),
        day("date_submission").alias("date_application"), *[day(c).alias(c) for c in ("date_conditions", "date_agreement", "date_energisation")], cell("refusal_reason").alias("refusal_reason"),
        F.when(section == 3, day("date_advance_payment")).alias("_date_advance_payment"), F.concat(F.lit("Art. 7(8l), item "), section.cast("string")).alias("_section"), F.when(section == 1, cell("date_agreement")).alias("_source_note"),
        *[cell(c).alias(to) for to, c in {"_applicant_kind": "entity_kind", "_installation_kind_raw": "kind", "_status_raw": "application_status", "_document_item_no": "item_no"}.items()],
    ]
    return _out(raw, columns, "pl_boryszew")


def section_nodes(words: DataFrame, left: float = 260.0) -> DataFrame:
    """document, node_name, year, kw of section 2: lines that begin with STACJA, numbers to the right of left as values, under the last line of years; a value without a year is named by its column."""
    own = sectioned(words).where("section = 2")
    each = own.select(*PAGE, "line", F.col("words").alias("ws"))
    texts = F.transform("ws", lambda w: w["text"])
    years = F.when((F.size("ws") >= 4) & F.forall("ws", lambda w: w["text"].rlike(r"^20\d{2}$")), texts)
    each = layout.carry_forward(each.withColumn("seq", F.struct("page", "line")), years, ["document"], "seq", "years")
    value = lambda w: w["text"].rlike(r"^-?\d+([.,]\d+)?$") & (w["x0"] > left)
    rows = each.where(F.upper(F.col("ws")[0]["text"]).startswith("STACJA")).select("document", "years", F.array_join(F.transform(F.filter("ws", lambda w: ~value(w)), lambda w: w["text"]), " ").alias("node_name"), F.posexplode(F.filter("ws", value)).alias("i", "w"))
    return rows.select("document", "node_name", F.coalesce(F.get("years", F.col("i")), F.concat(F.lit("kol"), F.col("i").cast("string"))).alias("year"), power_kw(F.col("w.text"), "MW").alias("kw"))


# The cells of the ruled table of 29.
NODE_CELLS = (
    "community", "province", "municipality", "substation", "latitude", "longitude", "voltage", "available", "occupied", *(f"item_{i}" for i in range(9, 18)), "with_permit", "in_progress",
    "accepted", *(f"technology_{i}" for i in range(21, 26)), "limited", "transmission_node", "comment",
)


def node_table(words: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of a ruled table of exactly 29 columns whose rows begin with a numbered region; numbers are Spanish, capacities in MW, the date is in the document's name."""
    records = ruled_records(words, edges, r"^\d{2}\s*-", joiner=" ").where("record > 0").where(F.size("cells") == len(NODE_CELLS))
    raw = named(records, NODE_CELLS).withColumn("date_published", date_in_name(F.col("document")))
    text = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    n = lambda c: number(F.col(c), ".", ",")
    kw = lambda c: n(c) * 1000
    limited = F.upper(F.coalesce(text("limited"), F.lit("")))
    lat, lon = n("latitude"), n("longitude")

    def breakdown(names: list[str]) -> Column:
        parts = [F.when(kw(c) != 0, F.format_string(f"{c.rsplit('_', 1)[1]}=%.1f", kw(c))) for c in names]
        return F.nullif(F.array_join(F.array_compact(F.array(*parts)), ";"), F.lit(""))

    columns = [
        F.when(text("substation").isNotNull() & text("voltage").isNotNull(), F.concat(text("substation"), F.lit("|"), text("voltage"))).otherwise(text("substation")).alias("node_id"), text("substation").alias("node_name"),
        F.nullif(F.concat_ws(", ", text("municipality"), text("province")), F.lit("")).alias("location_text"), F.when(lat.isNotNull() & lon.isNotNull(), F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))).alias("coordinates"),
        F.concat(text("voltage"), F.lit(" kV")).alias("voltage_level"), kw("available").alias("capacity_available"), kw("occupied").alias("capacity_reserved"), F.when(limited.isin("SI", "SÍ"), True).when(limited == "NO", False).alias("constraint_flag"),
        F.lit("NODE").alias("_entity"), text("community").alias("_autonomous_community"), text("province").alias("_province"), kw("accepted").alias("_capacity_accepted_pending_kw"), kw("with_permit").alias("_capacity_occupied_with_permit_kw"),
        kw("in_progress").alias("_capacity_occupied_in_progress_kw"), breakdown([c for c in NODE_CELLS if c.startswith("technology_")]).alias("_breakdown_by_technology_kw"), breakdown([c for c in NODE_CELLS if c.startswith("item_")]).alias("_breakdown_by_item_kw"),
        text("transmission_node").alias("_transmission_node"), text("comment").alias("_comment"),
    ]
    return _out(raw, columns, "es_edistribucion")


# ---------------------------------------------------------------- workbooks


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of workbooks, read once: readers take dates, headers and rows from them in several passes, each of which would parse every sheet again."""
    workbook.register(spark)
    return written(spark.read.format("workbook").load(path), "cells")


def _headed(cells: DataFrame, hit: Column, within: int = 12) -> DataFrame:
    """Cells below the first row (of the first so many) of their sheet in which hit is true for a cell, with that row as head."""
    head = cells.where(hit & (F.col("row") <= within)).groupBy("document", "sheet").agg(F.min("row").alias("head"))
    return cells.join(head, ["document", "sheet"])


def workbook_applications(cells: DataFrame, sheet: str = "Wykaz wspólny") -> DataFrame:
    """The common template as a sheet of 27 columns below the header with "id obiektu". Rows without an operator are the legend. Superscripts come back as footnotes by logical column; the date stands in the first row."""
    own = cells.where(F.col("sheet") == sheet)
    dates = own.where("row = 1").groupBy("document").agg(as_at(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " ")).alias("date_published"))
    body = _headed(own, F.lower(F.trim("text")).startswith("id obiektu")).where("row > head")
    names = F.array(*[F.lit(c) for c in WORKBOOK_COLUMNS])
    logical = F.coalesce(F.get(names, F.col("col") - 1), F.concat(F.lit("kol"), (F.col("col") - 1).cast("string")))
    marks = F.array_sort(F.collect_list(F.when(F.col("sup") != "", F.concat(logical, F.lit("="), F.col("sup")))))
    raw = body.groupBy("document", "row").agg(*[F.max(F.when(F.col("col") == i, F.nullif(F.col("text"), F.lit("")))).alias(c) for i, c in enumerate(WORKBOOK_COLUMNS, 1)], F.nullif(F.array_join(marks, "; "), F.lit("")).alias("_footnotes"))
    raw = raw.where(F.trim(F.coalesce("osd_osp", F.lit(""))) != "").withColumn("_seq", F.col("row").cast("long"))
    raw = _stamped(raw, dates)
    return _out(raw, [*template_columns(raw, "pse", ["_seq"]), F.col("_footnotes")], "pl_pse")


def workbook_slots(cells: DataFrame) -> DataFrame:
    """Stations with their number of free slots, from the sheets that name "rozdzielni"; columns are found by what their header says."""
    own = cells.where(F.contains(F.lower("sheet"), F.lit("rozdzielni")))
    dates = own.groupBy("document").agg(F.min_by(as_at(F.col("text")), F.when(as_at(F.col("text")).isNotNull(), F.struct("row", "col"))).alias("date_published"))
    headed = _headed(own, F.contains(F.lower("text"), F.lit("symbol stacji")))
    # What the headers say, and the columns that are meant.
    said = {"symbol": "symbol stacji", "name": "nazwa stacji", "switchgear": "rozdzielnia", "slots": "liczba dostępnych", "centre": "zko"}
    labels = headed.where("row = head").select("document", "sheet", F.col("col"), F.lower("text").alias("label"))
    first = {to: labels.where(F.contains("label", F.lit(part))).groupBy("document", "sheet").agg(F.min("col").alias("col")).select("document", "sheet", "col", F.lit(to).alias("to")) for to, part in said.items()}
    chosen = reduce(lambda a, b: a.unionAll(b), first.values())
    raw = headed.where("row > head").join(chosen, ["document", "sheet", "col"]).groupBy("document", "sheet", "row").agg(*[F.max(F.when(F.col("to") == to, F.trim("text"))).alias(to) for to in said])
    raw = _stamped(raw.where("symbol IS NOT NULL AND name IS NOT NULL").withColumn("_seq", F.col("row").cast("long")), dates)
    digits = F.regexp_extract(F.coalesce("switchgear", F.lit("")), r"(\d+)", 1)
    slots = number(F.col("slots"))
    columns = [
        F.concat(F.lit("pse:"), "symbol", F.lit(":"), F.when(digits == "", "nn").otherwise(digits)).alias("node_id"), F.col("name").alias("node_name"), F.col("name").alias("location_text"), voltage_tag(F.col("switchgear")).alias("voltage_level"),
        F.lit("UNSPECIFIED").alias("resource_class"), F.lit("UNSPECIFIED").alias("process_status"), (slots == 0).alias("constraint_flag"), F.lit("NODE").alias("_entity"), slots.alias("_free_slots"), F.col("symbol").alias("_station_symbol"), F.col("switchgear").alias("_switchgear"), F.col("centre").alias("_pse_coordination_centre"),
    ]
    return _out(raw, columns, "pl_pse")


# The labels of the heat map's second row by what they hold.
HEAT_LABELS = {
    "station": "Station Name", "group": "Transformer GroupID", "primary_voltage": "Primary kV", "voltage_class": "Voltage Class", "configuration": "Transformer Configuration", "installed": "Installed Capacity MVA", "demand_firm": "Demand FirmCapacity MVA",
    "demand_available": "Demand Available MVA", "demand_parent": "Parent Available MVA", "demand_limit": "Demand Parent Constraint", "firm": "Generation Firm Capacity MW", "committed": "Generation Total Committed MW", "available": "Gen Available Firm MW",
    "available_nonfirm": "Gen Available NonFirm MW", "limit": "Generation Parent Constraint", "feeder": "Parent Feeder", "parent": "Parent Station", "tie": "TSO Interface Station", "comment": "Comment", "latitude": "Latitude", "longitude": "Longitude",
}


def workbook_heat(cells: DataFrame, sheet: str = "Heatmap data") -> DataFrame:
    """A heat map: the sheet of that name or else the first, columns by the labels of its second row, rows that name a station. Generation in MW becomes kW; demand stays in MVA. An empty constraint is none; unknown or none is unknown."""
    choice = cells.groupBy("document").agg(F.min(F.when(F.col("sheet") == sheet, F.col("sheet_no"))).alias("own"), F.min("sheet_no").alias("any")).select("document", F.coalesce("own", "any").alias("sheet_no"))
    own = cells.join(choice, ["document", "sheet_no"])
    labels = own.where("row = 2").groupBy("document", F.trim("text").alias("label")).agg(F.min("col").alias("col"))
    named_cells = own.where("row > 2").join(labels, ["document", "col"]).where(~F.trim("text").isin("", "_", "-"))
    raw = named_cells.groupBy("document", "row").agg(*[F.max(F.when(F.col("label") == label, F.col("text"))).alias(c) for c, label in HEAT_LABELS.items()]).where("station IS NOT NULL").withColumn("_seq", F.col("row").cast("long"))
    n = lambda c: number(F.col(c), ",", ".")
    kw = lambda c: n(c) * 1000

    def constrained(c: str) -> Column:
        text = F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
        return F.when(text == "", False).when(text.isin("yes", "y", "true", "constrained", "1"), True).when(text.isin("no", "n", "false", "unconstrained", "0"), False).when(F.contains(text, F.lit("constrained")), True)

    demand, generation = constrained("demand_limit"), constrained("limit")
    both = F.when(F.coalesce(demand, F.lit(False)) | F.coalesce(generation, F.lit(False)), True).otherwise(both_known_or(demand, generation))
    columns = [
        F.when(F.col("group").isNotNull(), F.concat("station", F.lit("|"), "group")).otherwise(F.col("station")).alias("node_id"), F.trim("station").alias("node_name"), F.when(n("latitude").isNotNull() & n("longitude").isNotNull(), F.concat(n("latitude").cast("string"), F.lit(","), n("longitude").cast("string"))).alias("coordinates"),
        F.trim("primary_voltage").alias("voltage_level"), kw("available").alias("capacity_available"), kw("committed").alias("capacity_reserved"), both.alias("constraint_flag"), F.lit("NODE").alias("_entity"), F.lit("MVA").alias("_demand_capacity_unit"),
        *[F.col(c).alias(to) for to, c in {"_voltage_class": "voltage_class", "_transformer_configuration": "configuration", "_demand_constraint_description": "demand_limit", "_generation_constraint_description": "limit", "_supply": "feeder", "_upstream_station": "parent", "_transmission_interface": "tie", "_comment": "comment"}.items()],
        *[n(c).alias(to) for to, c in {"_capacity_installed_mva": "installed", "_demand_available_mva": "demand_available", "_demand_firm_mva": "demand_firm", "_demand_upstream_mva": "demand_parent"}.items()],
        demand.alias("_demand_constraint"), generation.alias("_generation_constraint"), stated_kva(F.col("demand_limit")).alias("_demand_unconstrained_kva"), stated_kva(F.col("limit")).alias("_generation_unconstrained_kva"),
        *[kw(c).alias(to) for to, c in {"_generation_available_non_firm_kw": "available_nonfirm", "_generation_contracted_kw": "committed", "_generation_firm_kw": "firm"}.items()],
    ]
    return _out(raw, columns, "ie_esbnetworks")


def missing_labels(cells: DataFrame) -> DataFrame:
    """document, missing: labels of the heat map that its second row does not have."""
    have = cells.where("row = 2").groupBy("document").agg(F.collect_set(F.trim("text")).alias("have"))
    return have.select("document", F.array_sort(F.array_except(F.array(*[F.lit(x) for x in HEAT_LABELS.values()]), "have")).alias("missing"))


def _pse(spark: SparkSession, path: str) -> DataFrame:
    cells = workbook_cells(spark, path)
    return union_panels([workbook_applications(cells), workbook_slots(cells)])


# ---------------------------------------------------------------- the registry


@dataclass(frozen=True)
class Publisher:
    """A publisher: the patterns of its documents' paths and texts (lower case), its reader, and which optional fields it discloses. printed: its documents are staged words."""

    name: str
    jurisdiction: str
    patterns: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    fields: tuple[str, ...]
    printed: bool = False


def _export(panel: Callable[[DataFrame], DataFrame], sep: str, key: str) -> Callable[[SparkSession, str], DataFrame]:
    """A CSV export's panel under the publisher's own name."""
    return lambda spark, path: panel(registers.read_export(spark, path, sep)).withColumns({"publisher": F.lit(PUBLISHERS[key].name), "jurisdiction": F.lit(PUBLISHERS[key].jurisdiction)})


_APPLICATION_FIELDS = ("application_id", "location_text", "voltage_level", "resource_class", "capacity_injected", "capacity_withdrawn", "process_status", "date_application", "date_conditions", "date_refusal", "refusal_reason", "date_agreement", "date_energisation", "date_published")
_of_words = lambda f: lambda spark, path: f(*staged(spark, path))

# The publishers in the order in which they are looked for, with their names, countries, patterns and fields.
PUBLISHERS: dict[str, Publisher] = {
    "pl_tauron": Publisher("TAURON Dystrybucja S.A.", "PL", ("tauron",), _of_words(station_list), ("application_id", "node_id", *_APPLICATION_FIELDS[1:]), True),
    "pl_energa": Publisher("ENERGA-OPERATOR S.A.", "PL", ("energa", "eop"), _of_words(printed_energa), (*_APPLICATION_FIELDS, "node_id", "node_name", "capacity_available"), True),
    "pl_pse": Publisher("PSE S.A.", "PL", ("pse", "art_7_ust_8l", "polskie sieci elektroenergetyczne"), _pse, (*_APPLICATION_FIELDS, "node_id", "node_name", "constraint_flag")),
    "pl_stoen": Publisher("Stoen Operator Sp. z o.o.", "PL", ("stoen",), _of_words(ruled_listings), tuple("capacity_reserved" if c == "capacity_injected" else c for c in _APPLICATION_FIELDS if c != "voltage_level"), True),
    "pl_boryszew": Publisher("Boryszew Green Energy&Gas Sp. z o.o.", "PL", ("boryszew", "elana"), lambda spark, path: printed_sections(staged(spark, path)[0]), tuple(c for c in _APPLICATION_FIELDS if c not in ("voltage_level", "capacity_injected", "date_refusal", "refusal_reason")), True),
    "es_edistribucion": Publisher("e-Distribución Redes Digitales S.L.U.", "ES", (r"edrd[_ ]?capacidad", r"capacidad[_ ]de[_ ]acceso", "e-?distribuci"), _of_words(node_table), ("node_id", "node_name", "location_text", "coordinates", "voltage_level", "capacity_available", "capacity_reserved", "constraint_flag", "date_published"), True),
    "ie_esbnetworks": Publisher("ESB Networks DAC", "IE", ("customer.?heatmap", "esb.?networks", "heatmap.?data"), lambda spark, path: workbook_heat(workbook_cells(spark, path)), ("node_id", "node_name", "coordinates", "voltage_level", "capacity_available", "capacity_reserved", "constraint_flag")),
    "pt_eredes": Publisher("E-REDES S.A.", "PT", ("capacidade.?rececao", "e.?redes", r"\brnd\b"), _export(registers.portal_panel, ";", "pt_eredes"), ("node_id", "node_name", "location_text", "voltage_level", "constraint_flag", "date_published")),
    "uk_nationalgrid": Publisher("National Grid Electricity Distribution", "UK", ("connection.?queue", "national.?grid"), _export(registers.queue_panel, ",", "uk_nationalgrid"), ("application_id", "node_id", "node_name", "location_text", "resource_class", "capacity_injected", "capacity_withdrawn", "constraint_flag", "queue_position", "process_status")),
}


def publisher(key: str) -> Publisher:
    if key not in PUBLISHERS:
        raise KeyError(f"unknown publisher {key!r}; known: {sorted(PUBLISHERS)}")
    return PUBLISHERS[key]


def matching(text: Column) -> Column:
    """The first publisher one of whose patterns occurs in the text; null if none does. One expression over all patterns."""
    said, out = F.lower(text), F.lit(None).cast("string")
    for key, p in reversed(PUBLISHERS.items()):
        out = F.when(said.rlike("|".join(f"(?:{x})" for x in p.patterns)), F.lit(key)).otherwise(out)
    return out


def detect(path: str) -> str | None:
    """The publisher of a document by its path alone."""
    return next((k for k, p in PUBLISHERS.items() if any(re.search(x, path.lower()) for x in p.patterns)), None)


def detect_documents(words: DataFrame, most: int = 4_000) -> DataFrame:
    """document, publisher of staged documents: by the document's name, else by the first so many characters of its first page; null if neither tells."""
    told = page_texts(words.where("page = 1")).select("document", matching(F.substring("text", 1, most)).alias("told"))
    # documents may be as many as words: they meet by an aggregate of short keys, and no text goes with them
    every = words.select("document").distinct().withColumn("told", F.lit(None).cast("string")).unionAll(told)
    return every.groupBy("document").agg(F.max("told").alias("told")).select("document", F.coalesce(matching(F.col("document")), "told").alias("publisher"))


def read(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The panel of one document, or of one folder of them."""
    key = key or detect(path)
    if key is None:
        raise ValueError(f"no publisher is known for {path}; keep the name that the publisher gave it, or name the publisher")
    return publisher(key).read(spark, path)


def read_staged(words: DataFrame, edges: DataFrame) -> DataFrame:
    """The panel of staged documents of any printed publishers, each routed by detect_documents."""
    routes = detect_documents(words)
    readers = {"pl_tauron": station_list, "pl_energa": printed_energa, "pl_stoen": ruled_listings, "pl_boryszew": lambda w, _: printed_sections(w), "es_edistribucion": node_table}

    def of(key: str) -> DataFrame:
        mine = routes.where(F.col("publisher") == key).select("document")
        return readers[key](words.join(mine, "document", "left_semi"), edges.join(mine, "document", "left_semi"))

    return union_panels([of(k) for k in readers])


def read_sources(spark: SparkSession, paths: list[str], source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The panel of all documents, and by document its rows and publication dates. An unknown document is named before any is read."""
    keys = [source or detect(p) for p in paths]
    for path, key in zip(paths, keys, strict=True):
        if key is None:
            raise ValueError(f"no source is known for {path}")
        publisher(key)
    panel = union_panels([read(spark, p, k) for p, k in zip(paths, keys, strict=True)])
    report = panel.groupBy("publisher", "source_document").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("date_published")).alias("dates"))
    return panel, report


def declarations(spark: SparkSession) -> DataFrame:
    """key, publisher, jurisdiction, fields, unknown: what each publisher says to disclose, and names in it that are no fields."""
    known = {f.name for f in FIELDS}
    return spark.createDataFrame([(k, p.name, p.jurisdiction, list(p.fields), sorted(set(p.fields) - known)) for k, p in PUBLISHERS.items()], "key string, publisher string, jurisdiction string, fields array<string>, unknown array<string>")
