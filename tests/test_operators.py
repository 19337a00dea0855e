import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import chartdata, editions, layout, nodes, panel, places, quality, survival


def test_schema(spark):
    assert len(panel.FIELDS) == 21 and [f.name for f in panel.FIELDS if f.core] == ["application_id", "location_text", "resource_class", "process_status"]
    assert panel.schema_table(spark).count() == 21


def test_core_by_entity(spark):
    rows = [("APPLICATION", "a", "l", "PV", 1.0, None, "X", None, None), ("APPLICATION", "a", "l", "PV", None, None, "X", None, None), ("NODE", None, None, None, None, None, None, "n", True), ("OTHER", "a", "l", "PV", 1.0, None, "X", "n", True)]
    df = spark.createDataFrame(rows, "_entity string, application_id string, location_text string, resource_class string, capacity_injected double, capacity_withdrawn double, process_status string, node_id string, constraint_flag boolean")
    assert [r[0] for r in df.select(panel.core_complete(df)).collect()] == [True, False, True, False]


def test_rules_on_an_empty_panel(spark):
    empty = spark.createDataFrame([], panel.SCHEMA)
    assert {r["code"]: r["violations"] for r in quality.run_quality(empty).collect()} == dict.fromkeys(("R1", "R2", "R3", "R4", "R5", "R6", "R7", "R8"), 0)


def test_rule_two_counts_twice(spark):
    df = spark.createDataFrame([("2020-02-29", "2022-03-01", "2022-03-01"), ("2020-01-01", "2022-01-01", None)], "date_conditions string, _date_expiry string, date_agreement string")
    assert [r[0] for r in df.select(quality.r2(df)).collect()] == [2, 0]


def test_rule_three_without_publisher(spark):
    df = spark.createDataFrame([(None, "CONDITIONS_ISSUED", None), (None, "CONDITIONS_ISSUED", "2020-01-01"), ("p", "CONDITIONS_ISSUED", None)], "publisher string, process_status string, date_conditions string")
    assert sorted(r["_tl_r3"] for r in quality.r3_rows(df).collect()) == [0, 0, 1]


def test_details_of_rules(spark):
    df = spark.createDataFrame([(None, "CONDITIONS_ISSUED", None, None, "a"), ("p", "CONDITIONS_ISSUED", "2020-01-01", "2020-02-01", None), ("q", "CONDITIONS_ISSUED", None, None, "b"), ("q", "REFUSED", None, None, None)], "publisher string, process_status string, date_conditions string, date_refusal string, application_id string")
    faults = [tuple(r) for r in quality.r3_details(df).collect()]
    # q discloses neither date; the row without a publisher is held to what the panel discloses
    assert faults == [("CONDITIONS_ISSUED", "missing", "date_conditions", 1), ("CONDITIONS_ISSUED", "unexpected", "date_refusal", 1)]
    assert [tuple(r) for r in quality.r3_details(df, most=1).collect()] == faults[:1]
    lacks = {(r["entity"], r["field"]): r["n"] for r in quality.r7_details(df).collect()}
    assert lacks[("APPLICATION", "application_id")] == 2 and lacks[("APPLICATION", "location_text")] == 4 and lacks[("APPLICATION", "at least one of: capacity_withdrawn, capacity_injected")] == 4
    assert not any(e == "NODE" for e, _ in lacks)
    assert quality.r3_details(df.where("false")).count() == quality.r7_details(df.where("false")).count() == 0
    assert {r["code"]: r["violations"] for r in quality.run_quality(df, only=("R3", "R6")).collect()} == {"R3": 2, "R6": 0}
    assert {r["code"]: r["violations"] for r in quality.run_quality(df, only=("R6",)).collect()} == {"R6": 0}


def test_messages(spark):
    df = spark.createDataFrame([("a", "l", "XX", "-5", "2020-13-01", "95,10")], "application_id string, location_text string, resource_class string, capacity_injected string, date_application string, coordinates string")
    said = df.select(panel.row_messages(df, strict=True)).first()[0]
    assert said == ["missing core field: process_status", "bad geopoint: coordinates", "bad number: capacity_injected", "bad date: date_application", "outside the vocabulary: resource_class"]


def test_kaplan_meier_vectors(spark):
    def median(rows):
        df = spark.createDataFrame(rows, "time_days int, event int")
        r = survival.km_summary(df).first()
        return r and (r["n"], r["events"], r["median"])

    assert median([(5, 1), (10, 1), (15, 1), (20, 1)]) == (4, 4, 10.0)
    assert median([(5, 0), (10, 0)]) == (2, 0, None)
    assert median([]) is None
    r = survival.km_summary(spark.createDataFrame([(i, 1) for i in range(1, 201)], "time_days int, event int")).first()
    assert r["median_lower"] <= r["median"] <= r["median_upper"]


def test_censoring(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2024, 1, 1), None, d(2024, 3, 1), "APPLICATION"), (d(2024, 1, 1), None, None, None), (d(2024, 2, 1), d(2024, 1, 1), None, None), (None, None, None, None), (d(2024, 1, 1), None, d(2024, 9, 1), "NODE")], "date_application date, date_conditions date, date_published date, _entity string")
    assert sorted((r["time_days"] if r["time_days"] is not None else -1, r["event"]) for r in survival.processing_time(df).collect() if r["event"] is not None) == [(60, 0), (60, 0), (244, 0)]


COLUMNS = "_seq long, publisher string, location_text string, voltage_level string, resource_class string, capacity_injected double, capacity_withdrawn double, process_status string, _applicant string, _facility_name string"


def edition(spark, rows):
    return spark.createDataFrame([(i, "p", *r) for i, r in enumerate(rows)], COLUMNS)


def test_an_edition_against_itself(spark):
    a = edition(spark, [("x", "SN", "PV", 1.0, None, "UNDER_REVIEW", None, None), ("x", "SN", "PV", 1.0, None, "REFUSED", None, None), (None, None, "PV", 2.0, None, None, None, None)])
    r = editions.compare(a, a).first()
    assert (r["rows_a"], r["unique_a"], r["shared"], r["new"], r["gone"], r["status_changes"], r["collision_rows_a"], r["forward_share"]) == (3, 2, 2, 0, 0, 0, 2, None)


def test_refusal_is_forward(spark):
    a = edition(spark, [("x", "SN", "PV", 1.0, None, "UNDER_REVIEW", None, None), ("y", "SN", "PV", 1.0, None, "CONDITIONS_ISSUED", None, None)])
    b = edition(spark, [("x", "SN", "PV", 1.0, None, "REFUSED", None, None), ("y", "SN", "PV", 1.0, None, "UNDER_REVIEW", None, None)])
    r = editions.compare(a, b).first()
    assert (r["status_changes"], r["backward"], r["forward_share"], r["is_monotone"]) == (2, 1, 0.5, False)


def test_blank_identity(spark):
    a = edition(spark, [("x", "SN", "PV", 1.0, None, "UNDER_REVIEW", None, None)])
    b = edition(spark, [("x", "WN", "PV", 1.0, None, "UNDER_REVIEW", None, None)])
    assert editions.linkage_recall(a, b).first()["recovered"] == 1
    assert editions.linkage_recall(a, b, exclude_blank=True).first()["recovered"] == 0


def test_key_needs_a_field(spark):
    with pytest.raises(ValueError):
        editions.with_key(spark.range(1))


def test_row_order_does_not_matter(spark):
    a = edition(spark, [(str(i % 7), "SN", "PV", 1.0, None, "UNDER_REVIEW" if i % 2 else "REFUSED", None, None) for i in range(40)])
    assert editions.compare(a, a.orderBy(F.rand(3))).collect() == editions.compare(a.orderBy(F.rand(5)), a).collect()


def test_assignment(spark):
    stations = nodes.station_map(spark.createDataFrame([(1, "N1", "Alfa, Beta", 1), (2, "N2", "Beta", 2)], "_group_no int, node_name string, location_text string, _seq long"))
    apps = spark.createDataFrame([("GPZ Alfa",), ("przy stacji Alfa 110",), ("Beta",), ("w linii Alfa - Beta",), ("Gamma",), (None,)], "location_text string")
    got = {r["location_text"]: (r["group_match"], r["group"]) for r in nodes.assign(apps, stations).collect()}
    assert got == {"GPZ Alfa": ("EXACT", 1), "przy stacji Alfa 110": ("EXTENDED", 1), "Beta": ("AMBIGUOUS", None), "w linii Alfa - Beta": ("LINE", None), "Gamma": ("NONE", None), None: ("NONE", None)}


def test_long_station_names_are_contained(spark):
    long = "Zakład Wodociągów i Kanalizacji w Nowym Mieście nad Rzeką Małą Stację"
    stations = nodes.station_map(spark.createDataFrame([(1, "N1", long, 1), (2, "N2", "Beta", 2)], "_group_no int, node_name string, location_text string, _seq long"))
    apps = spark.createDataFrame([(f"przy {long} od strony drogi",), ("obok Beta 110",)], "location_text string")
    got = {r["location_text"]: (r["group_match"], r["group"]) for r in nodes.assign(apps, stations).collect()}
    assert got == {f"przy {long} od strony drogi": ("EXTENDED", 1), "obok Beta 110": ("EXTENDED", 2)}


def test_same_node_name_hides_ambiguity_unless_strict(spark):
    stations = nodes.station_map(spark.createDataFrame([(1, "N", "Beta", 1), (2, "N", "Beta", 2)], "_group_no int, node_name string, location_text string, _seq long"))
    apps = spark.createDataFrame([("Beta",)], "location_text string")
    assert nodes.assign(apps, stations).first()["group_match"] == "EXACT"
    assert nodes.assign(apps, stations, strict=True).first()["group_match"] == "AMBIGUOUS"


def test_places(spark):
    gaz = places.gazetteer(spark.createDataFrame([("Jana Pawła", 52.0, 21.0, 1), ("Marsa", 52.1, 21.1, 2), ("Józefa Bema", None, None, 3), ("Stara Droga Polna", 52.2, 21.2, 4), ("Polna", 52.3, 21.3, 5)], "name string, lat double, lon double, _seq long"))
    asked = ["jana pawła", "Warszawa, ul. Marsa 5", "BEMA J.", "Marsa / Polna", "", "ABC12", "nowhere", "działka obok wielkiego starego domu marsa"]
    got = {r["query"]: (r["confidence"], r["matched"], r["reason"]) for r in places.resolve(spark.createDataFrame([(q,) for q in asked], "query string"), gaz).collect()}
    assert got["jana pawła"][:2] == ("EXACT", "Jana Pawła")
    assert got["Warszawa, ul. Marsa 5"][:2] == ("UNIQUE_TOKEN", "Marsa")
    assert got["BEMA J."][1] == "Józefa Bema"
    assert got["Marsa / Polna"][:2] in (("INTERSECTION", "Marsa / Polna"), ("UNIQUE_TOKEN", "Marsa"))
    assert got[""] == ("NONE", None, "empty_description") and got["ABC12"] == ("NONE", None, "station_code_without_dictionary") and got["nowhere"] == ("NONE", None, "no_candidates")
    assert got["działka obok wielkiego starego domu marsa"] == ("NONE", None, "verbal_description_not_street_name")


def test_crossing_of_axes(spark):
    line = lambda *p: [{"lat": a, "lon": b} for a, b in p]
    streets = [
        ("Biala Dolna", 1.0, 1.0, 1, line((0.0, 1.0), (2.0, 1.0))),
        ("Biala Gorna", 1.0, 3.0, 2, line((1.0, 0.0), (1.0, 4.0))),
        ("Czarna Dolna", 9.0, 9.0, 3, line((9.0, 9.0), (9.5, 9.0))),
        ("Czarna Gorna", 8.0, 8.0, 4, None),
    ]
    gaz = places.gazetteer(spark.createDataFrame(streets, "name string, lat double, lon double, _seq long, axis array<struct<lat:double,lon:double>>"))
    asked = ["Biala Dolna / Biala Gorna", "Biala Gorna / Czarna Dolna", "Biala Gorna / Czarna Gorna", "Biala Dolna", "nowhere", None]
    got = {r["query"]: tuple(r)[2:] for r in places.resolve(spark.createDataFrame([(q,) for q in asked], "query string"), gaz).collect()}
    assert got == {
        "Biala Dolna / Biala Gorna": (1.0, 1.0, "INTERSECTION", "matched 2 of 2 parts", "INTERSECTION_POINT"),
        "Biala Gorna / Czarna Dolna": (1.0, 3.0, "INTERSECTION", "matched 2 of 2 parts; the axes do not intersect, point taken from the first part", "STREET_AXIS_POINT"),
        "Biala Gorna / Czarna Gorna": (1.0, 3.0, "INTERSECTION", "matched 2 of 2 parts", "STREET_AXIS_POINT"),
        "Biala Dolna": (1.0, 1.0, "EXACT", None, "STREET_AXIS_POINT"),
        "nowhere": (None, None, "NONE", "no_candidates", None),
        "": (None, None, "NONE", "empty_description", None),
    }


def test_places_in_localities(spark):
    streets = [("Wola Dolna", "Marsa", 1.0, 2.0, 1), ("Wola Gorna", "Marsa", 3.0, 4.0, 2), ("Las Nowy", "11 Listopada", 5.0, 6.0, 3), ("Las Nowy", "TAMKA", None, None, 4)]
    gaz = places.gazetteer(spark.createDataFrame(streets, "locality string, name string, lat double, lon double, _seq long"))
    known = spark.createDataFrame([("Wola Dolna", None, None), ("Wola Gorna", None, None), ("Las Nowy", 9.0, 9.5)], "name string, lat double, lon double")
    points = spark.createDataFrame([("Wola Dolna", "Marsa", "12A", 1.5, 2.5), ("Las Nowy", "Tamka", "3/4", 7.0, 8.0)], "locality string, street string, number string, lat double, lon double")
    asked = spark.createDataFrame([(q,) for q in ("Wola Dolna, Marsa 12 a", "Wola Gorna, ul. Marsa 12A", "Wola, Marsa", "LAS, TAMKA 3 / 4", "Las, 11 Listopada", "LAS, TAMKA", "Las, nothing 5", "Las,", "Marsa", "Elsewhere, Marsa", "ABC12", "", None)], "query string")
    of = lambda **more: {r["query"]: tuple(r)[1:] for r in places.resolve_in(asked, gaz, known, points, **more).collect()}
    got = of()
    assert got["Wola Dolna, Marsa 12 a"] == ("Wola Dolna", "Marsa", 1.5, 2.5, "UNIQUE_TOKEN", "house_number=12a", "ADDRESS_POINT")
    assert got["Wola Gorna, ul. Marsa 12A"][:4] == ("Wola Gorna", "Marsa", 3.0, 4.0)
    assert got["Wola, Marsa"] == (None, None, None, None, "NONE", "ambiguous_locality:wola dolna|wola gorna", None)
    assert got["LAS, TAMKA 3 / 4"][2:4] == (7.0, 8.0) and got["LAS, TAMKA"][5:] == (None, "NO_GEOMETRY")
    assert got["Las, 11 Listopada"][1:] == ("11 Listopada", 5.0, 6.0, "EXACT", None, "STREET_AXIS_POINT")
    assert got["Las, nothing 5"] == ("Las Nowy", None, None, None, "NONE", "no_candidates", None) and got["Las,"][5] == "empty_description"
    assert [got[q][5] for q in ("Marsa", "Elsewhere, Marsa", "ABC12", "")] == ["no_locality_declared", "locality_not_in_gazetteer", "station_code_without_dictionary", "empty_description"]
    assert len(got) == 12
    more = of(default="Wola Dolna", allow_centroid=True)
    assert more["Marsa"][:4] == ("Wola Dolna", "Marsa", 1.0, 2.0)
    assert more["Las, nothing 5"][2:] == (9.0, 9.5, "NONE", "no_candidates", "LOCALITY_CENTROID")


def test_house_numbers(spark):
    street, number = places.house_number(F.col("v"))
    rows = spark.createDataFrame([("Marsa 12",), ("Marsa 85A",), ("Marsa 12/14",), ("Marsa",)], "v string").select(street, number).collect()
    assert [tuple(r) for r in rows] == [("Marsa", "12"), ("Marsa", "85A"), ("Marsa", "12/14"), ("Marsa", None)]


def test_layout(spark):
    words = spark.createDataFrame([(1, "a", 0.0, 10.0, 100.0), (1, "b", 60.0, 70.0, 101.5), (1, "c", 0.0, 10.0, 103.0)], "page int, text string, x0 double, x1 double, top double")
    lined = layout.lines(words)
    assert sorted((r["text"], r["line"]) for r in lined.collect()) == [("a", 0), ("b", 0), ("c", 1)]
    got = layout.cells(lined, F.array(F.lit(0.0), F.lit(50.0), F.lit(100.0))).collect()
    assert sorted((r["line"], r["column"], r["text"]) for r in got) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    fit = spark.createDataFrame([(["a"],), (["a", "b", "c", "d"],)], "c array<string>").select(layout.fit(F.col("c"), 3)).collect()
    assert [r[0] for r in fit] == [["a", "", ""], ["a", "b", "c d"]]


def test_shift_audit(spark):
    df = spark.createDataFrame([("UNDER_REVIEW", "12,5"), ("01.02.2024", "abc"), (None, "-")], "process_status string, capacity_withdrawn string")
    assert {r["field"]: r["rows"] for r in quality.column_shift(df).collect()} == {"process_status": 1, "capacity_withdrawn": 1, None: 1}


def test_shifted_rows(spark):
    df = spark.createDataFrame([(3, "2024-01-01", "x"), (1, None, "12"), (2, "PV", None), (4, "12", "5")], "k int, resource_class string, capacity_injected string")
    assert [tuple(r) for r in quality.shifted_rows(df, "k", 2).collect()] == [(3, ["capacity_injected", "resource_class"]), (4, ["resource_class"])]


def test_what_an_empty_panel_supports(spark):
    empty = spark.createDataFrame([], panel.SCHEMA)
    reasons = {r["chart"]: r["reason"] for r in chartdata.chart_inclusion(empty).collect()}
    assert reasons["processing_time"] == "date coverage 0.0% is below the 80% inclusion criterion" and reasons["field_coverage"] is None
    assert reasons["status_distribution"] == "no process status disclosed" and reasons["node_loading"] == "needs both node rows and application rows"
    assert panel.outside_vocabulary(empty).count() == 0
    assert panel.summary(empty).first()["n_fields_filled"] == 0 and survival.date_coverage(empty).first()["coverage"] == 0.0


def test_isolated_rules(spark):
    df = spark.createDataFrame([("a", "CONDITIONS_ISSUED", "5", "x"), ("a", "REFUSED", "abc", "y"), (None, "BOGUS", "-7", "z")], "application_id string, process_status string, capacity_injected string, publisher string")
    late = quality.Rule("X4", "fails while it runs", lambda d: F.col("process_status").cast("int"))
    rules = (*quality.ROW_RULES, quality.Rule("X1", "no column", lambda d: F.col("nowhere").isNull().cast("long")), quality.Rule("X2", "fails at once", lambda d: 1 / 0), quality.Rule("X3", "types", lambda d: F.col("process_status") + F.array(F.lit(1))))
    got = {r["code"]: r for r in quality.run_quality(df, rules).collect()}
    assert {c: r["violations"] for c, r in got.items()} == {"R1": 0, "R2": 0, "R3": 0, "R4": -1, "R5": -1, "R6": 1, "R7": 3, "R8": 1, "X1": -1, "X2": -1, "X3": -1}
    assert got["R4"]["error"] == "1 values of capacity_injected are no numbers" and got["R4"]["share"] is None and got["X2"]["error"].startswith("ZeroDivisionError") and got["R8"]["error"] is None
    report = quality.quality_report(df, (*rules, late))
    assert {r["code"]: r["violations"] for r in report["rules"]} == {c: r["violations"] for c, r in got.items()} | {"X4": -1} and report["n_rows"] == 3 and report["violations_total"] == -1


def test_sums_of_publishers(spark):
    df = spark.createDataFrame([("p", "a"), ("q", "a"), ("q", "b"), ("q", "b"), (None, "b"), (None, None)], "publisher string, application_id string")
    got = {(r["publisher"], r["is_total"]): r["violations"] for r in quality.quality_sums(df).where("code = 'R6'").collect()}
    assert got == {("p", False): 0, ("q", False): 1, (None, True): 3}
    row = quality.sum_check(df).first()
    assert (row["n_rows"], row["n_publishers"]) == (6, 2) and "R6:1/3" in row["mismatch"] and "R7:4/6" in row["mismatch"]
    assert quality.sum_check(df.limit(0)).first()["mismatch"] == ""


def test_numbered(spark):
    from pyspark.sql import functions as F

    from tallyloom.functions.tables import numbered

    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("id")).repartition(9)
    rows = numbered(df, [F.desc("a"), F.col("id")]).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 1001))
    order = [(-r["a"], r["id"] is not None, r["id"] or 0) for r in sorted(rows, key=lambda r: r["rank"])]
    assert order == sorted(order) and numbered(df.limit(0), [F.col("a")]).collect() == []
    same = numbered(spark.range(50).select(F.lit(1).alias("x")), [F.col("x")])
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 51)) and same.collect() == same.collect()


def test_lines_of_a_large_page(spark):
    words = spark.range(100_000).select(F.lit(1).alias("page"), F.col("id").cast("string").alias("text"), (F.col("id") % 50).cast("double").alias("x0"), (F.col("id") % 50 + 1).cast("double").alias("x1"), (F.floor(F.col("id") / 50) * 5 + F.col("id") % 3 * 0.9).cast("double").alias("top"))
    got = layout.lines(words.unionByName(words.limit(1).withColumn("top", F.lit(None).cast("double")).withColumn("page", F.lit(2))))
    assert got.where("page = 1").agg(F.max("line")).first()[0] == 1999 and got.where("page = 1 AND line <> floor(cast(text as long) / 50)").isEmpty()
    assert got.where("page = 2").first()["line"] == 0


def test_long_axes_cross(spark):
    n = 10_000
    a = [(50 + i / n, 20 + (i % 2) * 1e-5) for i in range(n)]
    b = [(50.25 + (i % 2) * 1e-5, 19.5 + i / n) for i in range(n)]
    axis = "array<struct<lat:double,lon:double>>"
    got = places.axis_crossing(spark.createDataFrame([(1, a, b), (2, a[:2], b[:2]), (3, [(1.0, 1.0)], b), (4, [(50.0, 20.0), (50.5, 20.0)], [(50.25, 19.0), (50.25, 21.0)])], f"id long, axis_a {axis}, axis_b {axis}")).collect()
    assert sorted((r["id"], r["lat"], r["lon"]) for r in got) == [(1, 50.25, 20.0), (4, 50.25, 20.0)]


def test_nodes_without_entity(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "node_id string, capacity_available double")
    assert [r["node_id"] for r in nodes.node_rows(df).collect()] == ["a"] and nodes.node_rows(df.drop("capacity_available")).count() == 0
    assert nodes.node_rows(df.withColumn("_entity", F.lit("node"))).count() == 2


def test_resolvers(spark):
    streets = spark.createDataFrame([("Polna", 50.0, 20.0, 1), ("Leśna Dolna", None, None, 2)], "name string, lat double, lon double, _seq long")
    df = spark.createDataFrame([("Polna", False, None), ("polna", True, None), ("Lesna Dolna", None, "1,2"), (None, None, None)], "location_text string, code boolean, coordinates string")
    got = sorted((str(r["location_text"]), r["coordinates"], r["_geo_confidence"], r["_geo_reason"]) for r in places.geocode(df, places.Gazetteer(streets), station_code_column="code").collect())
    assert got == [("Lesna Dolna", "1,2", "SOURCE", None), ("None", None, "NONE", "empty_description"), ("Polna", "50.000000,20.000000", "EXACT", None), ("polna", None, "NONE", "station_code_without_dictionary")]
    towns = spark.createDataFrame([("Toruń",)], "name string")
    many = places.Localities(streets.withColumn("locality", F.lit("Toruń")), towns)
    assert places.geocode(spark.createDataFrame([("Torun, Polna",)], "location_text string"), many).first()["coordinates"] == "50.000000,20.000000"


def test_all_charts(spark, tmp_path):
    from tallyloom.sources import registers

    df = registers.synthetic_panel(spark, 200)
    saved, skipped = chartdata.save_all(df, str(tmp_path / "charts"), edition_b=df)
    assert {"field_coverage", "quality_rules", "column_shift", "status_distribution", "capacity_by_class", "edition_flows"} <= set(saved) and {"node_loading", "location_resolution"} <= {c for c, _ in skipped}
    assert all(spark.read.parquet(f"{tmp_path}/charts/{c}").columns for c in saved) and set(saved).isdisjoint(c for c, _ in skipped)


def test_editions_carry_only_what_they_compare(spark):
    rows = [(1, "p", "here", "SN", "PV", 1.0, None, "UNDER_REVIEW", "A", "F", "long remarks"), (2, "p", "there", "SN", "PV", 2.0, None, "REFUSED", "B", "G", "longer remarks")]
    a = spark.createDataFrame(rows, "_seq long, publisher string, location_text string, voltage_level string, resource_class string, capacity_injected double, capacity_withdrawn double, process_status string, _applicant string, _facility_name string, _remarks string")
    b = a.withColumn("capacity_injected", F.when(F.col("_seq") == 2, 3.0).otherwise(F.col("capacity_injected")))
    for f in (editions.compare, editions.transitions, editions.linkage_audit, editions.linkage_discrepancies, editions.recovered, editions.linkage_recall):
        assert "_remarks" not in f(a, b)._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0], f
    assert [tuple(r) for r in editions.recovered(a, b).collect()] == [("B|G", "REFUSED", "REFUSED", "capacity_injected")]
    assert editions.linkage_recall(a, b).first()["recovered"] == 1 and editions.compare(a, b).first()["shared"] == 1
