"""From documents to panels: printed ones as staged words, workbooks and exports as files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import layout
from tallyloom.sources import adapters, registers, workbook

WORDS = "document string, page int, text string, x0 double, x1 double, top double"
EDGES = "document string, page int, x0 double, top double, bottom double"


def printed(spark, document, pages, step=60.0):
    """Staged tables of pages of rows of cells; a cell's words stand in its column, its lines (\\n) below one another. A page may have text lines above, as plain strings."""
    words, edges = [], []
    for no, rows in enumerate(pages, 1):
        top = 10.0
        for row in rows:
            if isinstance(row, str):
                for i, w in enumerate(row.split()):
                    words.append((document, no, w, 5.0 + 40 * i, 40.0 + 40 * i, top))
                top += 12
                continue
            deep = max(len(c.split("\n")) for c in row)
            for i, cell in enumerate(row):
                for j, line in enumerate(cell.split("\n")):
                    for n, w in enumerate(line.split()):
                        words.append((document, no, w, i * step + 3 + 8 * n, i * step + 9 + 8 * n, top + 5 * j))
            top += 5 * deep + 7
        width = max((len(r) for r in rows if not isinstance(r, str)), default=0)
        if width:
            edges += [(document, no, i * step, 0.0, 700.0) for i in range(width + 1)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(edges, EDGES)


def row(width, cells):
    return [cells.get(i, "") for i in range(width)]


def test_station_list(spark):
    cells = {0: "1", 1: "O-1", 2: "T", 3: "firma", 4: "SKB3", 5: "110 kV", 6: "nie", 7: "FW", 8: "1,5", 10: "1", 11: "0,5", 16: "warunki\nprzylaczenia", 17: "05.03.2024", 19: "1.4.2024"}
    pages = [["Stan na 30.06.2026", row(27, {0: "Lp."}), row(27, cells)], [row(27, {0: "2", 1: "O-2", 7: "PV", 16: "odmowa"}), row(27, {0: "x", 1: "no"})], ["FW - farma wiatrowa"]]
    words, edges = printed(spark, "t.pdf", pages)
    got = adapters.station_list(words, edges).orderBy("_seq").collect()
    r = got[0]
    assert (r["application_id"], r["node_id"], r["voltage_level"], r["resource_class"], r["capacity_injected"], r["process_status"], r["date_application"], r["date_conditions"], r["date_published"], r["_capacity_installed_kw"]) == ("O-1", "SKB3", "110 kV", "WIND", 1500.0, "CONDITIONS_ISSUED", dt.date(2024, 3, 5), dt.date(2024, 4, 1), dt.date(2026, 6, 30), 1500.0)
    # a line without a number belongs to the record above it
    assert [x["application_id"] for x in got] == ["O-1", "O-2 no"] and got[1]["process_status"] == "REFUSED" and got[1]["_capacity_installed_kw"] is None
    assert [tuple(x) for x in layout.legend(adapters.page_lines(words).where("page = 3")).collect()] == [("FW", "farma wiatrowa")]


def test_printed_template_and_groups(spark):
    apps = {0: "7.", 1: "-", 2: "Op", 3: "X sp.", 4: "Place", 5: "110; 220 kV", 7: "PV", 8: "129\n240", 9: "2;3", 10: "5", 16: "wniosek", 17: "2024-01-02", 25: "po 30.06.2026", 24: "po 30.06.2026"}
    a = printed(spark, "energa_a.pdf", [["Stan na dzień 30.06.2026 r.", row(28, {0: "Lp."}), row(28, apps)]])
    year = ["2026", "2027", "2028"]
    pages = [
        ["Wykaz dostępnej odbiorczej mocy", "(STAN NA DZIEŃ 31.08.2026 ROKU)"],
        ["Tabela 2.1 Grupy", row(4, {0: "", 1: "Oddział Gdańsk"}), row(4, {0: "2", 1: "G2", 2: "AA,\nBB", 3: "brak"})],
        ["Tabela 2.1 Grupy", row(4, {0: "10", 1: "G10", 2: "CC"})],
        ["Tabela 2.3 Wartości", ["Nr", "Nazwa", *year], ["10", "G10", "1,5", "-", "3"], ["2", "G2", "0", "7", ""]],
        ["Tabela 2.4 Analiza", ["Nr", "Nazwa", *year], ["2", "G2", "9", "9", "9"]],
    ]
    b = printed(spark, "energa_b.pdf", pages)
    got = {r["_seq"]: r for r in adapters.printed_energa(a[0].unionAll(b[0]), a[1].unionAll(b[1])).where("_entity = 'NODE'").collect()}
    assert sorted(got) == [2, 10]
    two, ten = got[2], got[10]
    assert (two["node_id"], two["node_name"], two["location_text"], two["_branch"], two["_changes_by_year"], two["capacity_available"], two["_capacity_available_2027"], two["_capacity_available_2028"], two["_capacity_available_analytical"]) == ("energa:grupa110:2:demand", "G2", "AA, BB", "Gdańsk", "brak", 0.0, 7000.0, None, 9000.0)
    assert (ten["_branch"], ten["capacity_available"], ten["_capacity_available_2027"], ten["_capacity_available_analytical"], ten["date_published"], ten["resource_class"]) == ("Gdańsk", 1500.0, None, None, dt.date(2026, 8, 31), "LOAD")
    (r,) = adapters.printed_energa(*a).collect()
    assert (r["application_id"], r["voltage_level"], r["capacity_injected"], r["_capacity_injected_components_mw"], r["capacity_withdrawn"], r["_capacity_withdrawn_components_mw"], r["_ic_pv"], r["date_energisation"], r["_energisation_text"], r["date_published"]) == ("energa:poz:7", "110; 220 kV", 369000.0, "129; 240", 5000.0, "2; 3", 5000.0, None, "po 30.06.2026", dt.date(2026, 6, 30))


def test_listings(spark):
    head = lambda *said: [row(11, {0: "Lp.", **{7 + i: s for i, s in enumerate(said)}})]
    base = {0: "1.", 1: "osoba", 2: "Warszawa", 3: "Polna 1", 4: "150", 5: "20", 6: "PV"}
    docs = {
        "stoen_a": [["Stan na 30.06.2026", *head("data zawarcia", "data rozpoczecia"), row(11, {**base, 7: "01.02.2024", 8: "01.03.2024"}), row(11, {**base, 0: "2", 7: "01.02.2024"})]],
        "stoen_b": [[*head("status rozpatrywania"), row(11, {**base, 7: "01.02.2024", 9: "w trakcie analizy"})]],
        "stoen_c": [[*head("data odmowy"), row(11, {**base, 2: "", 7: "01.02.2024", 9: "brak warunków", 10: "05.02.2024"})]],
        "other": [[*head("nic"), row(11, base)]],
    }
    made = [printed(spark, d, p) for d, p in docs.items()]
    words, edges = made[0]
    for w, e in made[1:]:
        words, edges = words.unionAll(w), edges.unionAll(e)
    got = {r["application_id"]: r for r in adapters.ruled_listings(words, edges).collect()}
    assert sorted(got) == ["stoen:applicants:1", "stoen:applicants:2", "stoen:applications:1", "stoen:refusals:1"]
    a, b, c = got["stoen:applicants:1"], got["stoen:applications:1"], got["stoen:refusals:1"]
    assert (a["process_status"], a["date_agreement"], a["capacity_withdrawn"], a["capacity_reserved"], a["location_text"], a["date_published"]) == ("AGREEMENT_IN_FORCE", dt.date(2024, 3, 1), 150.0, 20.0, "Warszawa, Polna 1", dt.date(2026, 6, 30))
    assert (got["stoen:applicants:2"]["process_status"], b["process_status"], b["date_application"], b["date_published"]) == ("CONDITIONS_ISSUED", "UNDER_REVIEW", dt.date(2024, 2, 1), None)
    assert (c["process_status"], c["refusal_reason"], c["date_refusal"], c["location_text"], c["_listing"]) == ("REFUSED", "brak warunków", dt.date(2024, 2, 5), "Polna 1", "refusals")
    assert [r[0] for r in adapters.unknown_listings(words, edges).collect()] == ["other"]


def test_sections(spark):
    pages = [
        ["Data aktualizacji publikacji: 5 marca 2026", "1. Podmioty ubiegające", row(8, {0: "Lp.", 1: "kto"}), ["1.", "osoba", "Toruń\nNowy", "2,5", "PV", "01.02.2024", "Nie", "-"], ["2.", *["brak"] * 7], ["3.", "osoba", "Toruń", "1", "odb", "01.02.2024", "02.03.2024", "05.05.2025"]],
        ["3. Złożone wnioski", ["1.", "firma", "Łódź", "4", "FW", "01.01.2024", "02.01.2024", "w trakcie analizy"]],
        ["4. Wydane odmowy", ["1.", "Łódź", "4", "FW", "01.01.2024", "02.01.2024", "brak mocy"], "2. Wartości mocy", "2026 2027 2028 2029"],
    ]
    words, _ = printed(spark, "boryszew.pdf", pages)
    extra = [("boryszew.pdf", 3, w, x, x + 20, 300.0) for w, x in (("Stacja", 5.0), ("A", 50.0), ("7", 100.0), ("10,5", 300.0), ("11", 360.0))]
    got = adapters.printed_sections(words.unionAll(spark.createDataFrame(extra, WORDS))).orderBy("_seq").collect()
    assert [(r["application_id"], r["process_status"], r["capacity_withdrawn"], r["location_text"], r["resource_class"]) for r in got] == [
        ("boryszew:pkt1:1", "CONDITIONS_ISSUED", 2500.0, "Toruń Nowy", "PV"), ("boryszew:pkt1:2", "CONNECTED", 1000.0, "Toruń", "LOAD"),
        ("boryszew:pkt3:1", "UNDER_REVIEW", 4000.0, "Łódź", "WIND"), ("boryszew:pkt4:1", "REFUSED", 4000.0, "Łódź", "WIND"),
    ]
    assert {r["date_published"] for r in got} == {dt.date(2026, 3, 5)} and got[3]["refusal_reason"] == "brak mocy" and got[0]["_source_note"] == "Nie"
    nodes = adapters.section_nodes(words.unionAll(spark.createDataFrame(extra, WORDS))).collect()
    assert sorted((r["node_name"], r["year"], r["kw"]) for r in nodes) == [("Stacja A 7", "2026", 10500.0), ("Stacja A 7", "2027", 11000.0)]


def test_node_table(spark):
    cells = {0: "01 - Andalucía", 1: "Cádiz", 2: "Rota", 3: "ROTA", 4: "36,5", 5: "-6,25", 6: "66", 7: "1.234,5", 8: "3", 9: "1", 18: "2", 21: "0,5", 26: "SÍ"}
    words, edges = printed(spark, "EDRD_Capacidad_2025_08_01.pdf", [[row(29, {0: "Comunidad"}), row(29, cells)], [row(20, {0: "02 - Aragón"})]])
    (r,) = adapters.node_table(words, edges).collect()
    assert (r["node_id"], r["coordinates"], r["voltage_level"], r["capacity_available"], r["capacity_reserved"], r["constraint_flag"], r["date_published"], r["_breakdown_by_technology_kw"], r["_breakdown_by_item_kw"], r["location_text"]) == ("ROTA|66", "36.5,-6.25", "66 kV", 1234500.0, 3000.0, True, dt.date(2025, 8, 1), "21=500.0", "9=1000.0", "Rota, Cádiz")


def sheet(name, rows):
    return [(name, i, j, t, "") if isinstance(t, str) else (name, i, j, *t) for i, r in rows.items() for j, t in r.items()]


def test_workbooks(spark, tmp_path):
    workbook.register(spark)
    apps = {1: {1: "Wykaz, stan na 30.06.2026"}, 3: {1: "ID obiektu", 2: "Nazwa"}, 4: {1: ("-", "1)"), 3: "PSE", 6: "110; 220", 8: "PV", 9: "1.5", 17: "wniosek", 18: "2024-02-03"}, 6: {1: "E- legenda"}}
    slots = {1: {1: "Stan na 31.08.2026"}, 2: {1: "ZKO", 2: "Symbol stacji", 3: "Nazwa stacji", 4: "Rozdzielnia", 5: "Liczba dostępnych miejsc"}, 3: {1: "K", 2: "ABC", 3: "Alfa", 4: "220 kV", 5: "0"}, 4: {2: "DEF", 3: "Beta", 5: "2"}, 5: {2: "GHI"}}
    heat = {1: {1: "x"}, 2: {1: "Station Name", 2: "Transformer GroupID", 3: "Gen Available Firm MW", 4: "Generation Parent Constraint", 5: "Latitude", 6: "Longitude"}, 3: {1: "S1", 2: "T1", 3: "1.5", 5: "53.5", 6: "-6.25"}, 4: {1: "S2", 4: "Constrained, otherwise capacity available = 1,250 kVA"}, 5: {1: "_", 3: "9"}}
    for name, rows in (("pse", sheet("Wykaz wspólny", apps) + sheet("Lista rozdzielni", slots)), ("heatmap", sheet("Heatmap data", heat))):
        spark.createDataFrame(rows, "sheet string, row int, col int, text string, sup string").coalesce(1).write.format("workbook").mode("overwrite").save(f"{tmp_path}/{name}")
    again = registers.cells_of_xlsx(spark, f"{tmp_path}/pse/*.xlsx").drop("document")
    cells = spark.read.format("workbook").load(f"{tmp_path}/pse")
    assert cells.rdd.getNumPartitions() == 2 and sorted(map(tuple, cells.select(again.columns).collect())) == sorted(map(tuple, again.collect()))
    panel = adapters.read(spark, f"{tmp_path}/pse")
    a = panel.where("_entity = 'APPLICATION'").collect()
    assert [(r["application_id"], r["voltage_level"], r["capacity_injected"], r["date_application"], r["date_published"], r["_footnotes"]) for r in a] == [("pse:poz:1", "110; 220 kV", 1500.0, dt.date(2024, 2, 3), dt.date(2026, 6, 30), "object_id=1)")]
    n = {r["node_id"]: r for r in panel.where("_entity = 'NODE'").collect()}
    assert sorted(n) == ["pse:ABC:220", "pse:DEF:nn"] and n["pse:ABC:220"]["constraint_flag"] is True and n["pse:DEF:nn"]["_free_slots"] == 2.0 and n["pse:DEF:nn"]["date_published"] == dt.date(2026, 8, 31)
    h = {r["node_id"]: r for r in adapters.read(spark, f"{tmp_path}/heatmap", "ie_esbnetworks").collect()}
    assert sorted(h) == ["S1|T1", "S2"] and (h["S1|T1"]["capacity_available"], h["S1|T1"]["coordinates"], h["S1|T1"]["constraint_flag"]) == (1500.0, "53.5,-6.25", False)
    assert h["S2"]["constraint_flag"] is True and h["S2"]["_generation_unconstrained_kva"] == 1250.0
    assert "Comment" in adapters.missing_labels(spark.read.format("workbook").load(f"{tmp_path}/heatmap")).first()["missing"]
    # a second write replaces the first; an empty one leaves none
    spark.createDataFrame([("S", 1, 28, "z", None)], "sheet string, row int, col int, text string, sup string").write.format("workbook").mode("overwrite").save(f"{tmp_path}/heatmap")
    assert [(r["row"], r["col"], r["text"]) for r in spark.read.format("workbook").load(f"{tmp_path}/heatmap").collect()] == [(1, 28, "z")]


def test_exports_are_cut_and_ordered(spark, tmp_path):
    path = tmp_path / "national_grid_queue.csv"
    path.write_text("Application ID,Machine ID,Fuel type,GSP\n" + "".join(f'{i},1,Solar,"G ""{i}"""\n' for i in range(3000)))
    assert not registers.spans_lines(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = registers.read_export(spark, str(path), ",")
        assert df.rdd.getNumPartitions() > 3
        assert [int(r[0]) for r in df.orderBy("_seq").select("Application ID").collect()] == list(range(3000))
        got = adapters.read(spark, str(path))
        assert got.where("node_name = 'G \"7\"'").count() == 1 and got.first()["publisher"] == adapters.PUBLISHERS["uk_nationalgrid"].name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text('Application ID,GSP\n1,"two\nlines"\n2,b\n')
    assert registers.spans_lines(spark, str(path)) and registers.read_export(spark, str(path), ",").count() == 2


def test_registry(spark):
    assert len(adapters.PUBLISHERS) == 9
    assert adapters.declarations(spark).where("size(unknown) > 0").isEmpty() and adapters.declarations(spark).count() == 9
    assert [adapters.detect(p) for p in ("x/TAURON_2026.pdf", "EDRD Capacidad.pdf", "e-redes.csv", "x.bin")] == ["pl_tauron", "es_edistribucion", "pt_eredes", None]
    with pytest.raises(KeyError, match="unknown publisher"):
        adapters.publisher("zz")
    with pytest.raises(ValueError, match=r"x\.bin"):
        adapters.read(spark, "x.bin")


def test_documents_are_routed(spark):
    long = " ".join(["word"] * 1000)
    made = [printed(spark, d, [[text]])[0] for d, text in (("a.pdf", "Stoen Operator"), ("b.pdf", long + " Stoen"), ("boryszew.pdf", "x"), ("c.pdf", "Polskie Sieci Elektroenergetyczne"))]
    words = made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])
    assert {r["document"]: r["publisher"] for r in adapters.detect_documents(words).collect()} == {"a.pdf": "pl_stoen", "b.pdf": None, "boryszew.pdf": "pl_boryszew", "c.pdf": "pl_pse"}


def test_documents_are_detected_without_a_broadcast(spark, tmp_path):
    printed(spark, "a.pdf", [["Stoen Operator"]])[0].write.parquet(f"{tmp_path}/words.parquet")
    got = adapters.detect_documents(spark.read.parquet(f"{tmp_path}/words.parquet"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("a.pdf", "pl_stoen")]


def test_lines_and_bounds_are_never_broadcast(spark, tmp_path):
    cells = {0: "1", 1: "O-1", 8: "1,5"}
    made = printed(spark, "t.pdf", [["Stan na 30.06.2026", row(27, {0: "Lp."}), row(27, cells)]])
    for df, name in zip(made, ("words", "edges"), strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    words, edges = adapters.staged(spark, str(tmp_path))
    for got in (adapters.printed_sections(words), adapters.station_list(words, edges)):
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["capacity_injected"] for r in adapters.station_list(words, edges).collect()] == [1500.0]


def test_lines_go_on_in_the_next_batch(spark):
    words = spark.createDataFrame([("d", p, f"w{i}", float(i % 7), float(i % 7) + 1, float(i // 7 * 5)) for p in (1, 2) for i in range(70)], WORDS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = layout.line_words(words, keys=adapters.PAGE).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["page"], r["line"], [w["text"] for w in r["words"]]) for r in got) == [(p, n, [f"w{7 * n + i}" for i in range(7)]) for p in (1, 2) for n in range(10)]


def test_only_words_of_ruled_pages_are_dealt(spark, tmp_path):
    cells = {0: "1", 1: "O-1", 16: "warunki\nprzylaczenia"}
    made = printed(spark, "t.pdf", [["Stan na 30.06.2026", row(27, {0: "Lp."}), row(27, cells)], ["no rules here"], [row(27, {0: "2", 1: "O-2"})]])
    for df, name in zip(made, ("words", "edges"), strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = adapters.station_list(*adapters.staged(spark, str(tmp_path)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # after the sorted pass over the words, lines and records are neither shuffled nor sorted again: nothing there is left to spill
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Exchange" in plan
    assert sorted((r["application_id"], r["process_status"], r["_seq"], r["date_published"]) for r in got.collect()) == [("O-1", "CONDITIONS_ISSUED", 1_000_001, dt.date(2026, 6, 30)), ("O-2", "UNSPECIFIED", 3_000_001, dt.date(2026, 6, 30))]
    # the sorted pass has as many tasks as its words ask for, also where the session has few
    many = spark.range(600_000).select(F.lit("d").alias("document"), (F.col("id") % 5000).cast("int").alias("page"), F.lit("w").alias("text"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("x1"), F.lit(3.0).alias("top"))
    assert layout.sorted_tasks(many) == 3
    assert [layout.sorted_tasks(spark.range(n)) for n in (0, 128_000_000, 4_000_000_000)] == [1, 200, 1001]


def test_records_go_on_in_the_next_batch(spark):
    words = spark.createDataFrame([("d", p, f"{i}-{x}", 10.0 * x + 1, 10.0 * x + 2, 10.0 * i) for p in (1, 2, 3) for i in range(7) for x in range(3)], WORDS)
    bounds = spark.createDataFrame([("d", p, [0.0, 10.0, 20.0, 30.0], f"of {p}") for p in (1, 3)], "document string, page int, bounds array<double>, also string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = layout.table_records(words, bounds, F.col("cells")[0].isin("2-0", "5-0"), keys=adapters.PAGE, tasks=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = {0: (0, 1), 1: (2, 3, 4), 2: (5, 6)}
    want = [(p, n, own[0], [" ".join(f"{i}-{x}" for i in own) for x in range(3)], f"of {p}") for p in (1, 3) for n, own in parts.items()]
    assert sorted((r["page"], r["record"], r["line"], r["cells"], r["also"]) for r in got) == want


def test_workbooks_are_parsed_once(spark, tmp_path):
    workbook.register(spark)
    rows = sheet("Wykaz wspólny", {1: {1: "Wykaz, stan na 30.06.2026"}, 3: {1: "ID obiektu"}, 4: {1: "A", 3: "PSE", 9: "1.5"}})
    spark.createDataFrame(rows, "sheet string, row int, col int, text string, sup string").coalesce(1).write.format("workbook").mode("overwrite").save(f"{tmp_path}/pse")
    got = adapters.read(spark, f"{tmp_path}/pse")
    assert "workbook" not in got._jdf.queryExecution().executedPlan().toString().lower().replace("/pse", "")
    assert [(r["application_id"], r["capacity_injected"]) for r in got.collect()] == [("A", 1500.0)]
