import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom import cli
from tallyloom.sources import registers
from tallyloom.streaming import editions as streams


def test_queue_csv(spark, tmp_path):
    path = tmp_path / "queue_2026.csv"
    path.write_text("Licence Area,GSP,TANM,DANM,Status,Bus Number,Bus Name,Application ID,Machine Export Capacity (MW),Machine Import Capacity (MW),Fuel type,Machine ID,Position\nA,G,True,,Accepted,1,B,7,1.5,,Solar,2,3\n")
    panel, report = registers.read_sources(spark, [str(path)])
    r = panel.first()
    assert (r["application_id"], r["capacity_injected"], r["constraint_flag"], r["resource_class"], r["process_status"], r["queue_position"]) == ("7/2", 1500.0, True, "PV", "AGREEMENT_IN_FORCE", 3.0)
    assert report.first()["rows"] == 1


def test_portal_csv(spark, tmp_path):
    path = tmp_path / "portal.csv"
    head = "codigo;instalacao;tipo_de_instalacao;grupo_de_subestacoes_rari;concelho;capacidade_de_recepcao_mt_at_mva_ultimo_trimestre;capacidade_de_recepcao_at_mva_ultimo_trimestre;capacidade_de_recepcao_mt_15kv_mva_ultimo_trimestre;data_ultimo_trimestre"
    lines = ["N1;Alfa;SE AT;Alfa, Beta;Porto;11,5;10;1,5;2T2026", "N2; Beta ;PC AT;;Braga;0;0;;4t2025", ";;outro;;;none;;;5T2026"]
    path.write_bytes("\n".join(["\ufeff" + head, *lines]).encode())
    rows = registers.read_sources(spark, [str(path)])[0].orderBy("_seq").collect()
    own = [(r["node_id"], r["node_name"], r["location_text"], r["voltage_level"], r["constraint_flag"], str(r["date_published"]), r["_installation_type"], r["_capacity_available_mva"]) for r in rows]
    assert own == [
        ("N1", "Alfa", "Alfa, Beta", "AT, 15 kV", False, "2026-06-30", "substation_HV", 11.5),
        ("N2", "Beta", None, None, True, "2025-12-31", "cutting_point_HV", 0.0),
        (None, None, None, None, None, "None", "outro", None),
    ]
    # MVA are not kW, and columns that the file lacks are null
    assert {(r["capacity_available"], r["capacity_reserved"], r["_nuts3"], r["_source_capacity_unit"], r["_entity"]) for r in rows} == {(None, None, None, "MVA", "NODE")}
    assert registers.detect("data/E-REDES 2026.csv") == "portal"


def test_unknown_file_is_named(spark):
    with pytest.raises(ValueError, match="strange.bin"):
        registers.read_sources(spark, ["strange.bin"])
    assert cli.main(["parse", "strange.bin"]) == 2


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>id obiektu</t></si><si><r><t>A</t></r><r><rPr><vertAlign val="superscript"/></rPr><t>1</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>moc</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')
    cells = registers.cells_of_xlsx(spark, str(tmp_path))
    assert {(r["row"], r["col"], r["text"], r["sup"]) for r in cells.collect()} == {(2, 1, "id obiektu", ""), (2, 2, "moc", ""), (3, 1, "A", "1"), (3, 2, "2.5", "")}
    rows = registers.sheet_rows(cells, F.lower("text") == "id obiektu", {1: "object_id", 2: "power_out"})
    panel = registers.template_panel(rows, "pub", "PL").first()
    assert (panel["application_id"], panel["capacity_injected"]) == ("A", 2500.0)
    assert registers.vocabulary(cells).where("col = 1").first()["values"] == ["A"]


def test_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "b.bin").write_bytes(b"y")
    listed = spark.createDataFrame([("a.bin", hashlib.sha256(b"x").hexdigest()), ("b.bin", "0"), ("c.bin", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in registers.manifest_check(spark, str(tmp_path / "*.bin"), listed).collect()} == {"a.bin": "matching", "b.bin": "different", "c.bin": "missing"}


def test_signatures(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"<!DOCTYPE html><p>not found", "c.xlsx": b"PK\x03\x04...", "d.csv": b"a;b", "e.csv": b"  <html>", "f.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    assert {r["name"]: r["sound"] for r in registers.document_signatures(spark, str(tmp_path)).collect()} == {"a.pdf": True, "b.pdf": False, "c.xlsx": True, "d.csv": True, "e.csv": False}


def test_gazetteer(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"miejscowosci": {"X": {"ulice": {"Polna": {"lat": 1.0, "lon": 2.0, "dlugosc_m": 30}}}}}')
    assert tuple(registers.gazetteer_json(spark, str(tmp_path / "g.json")).first()) == ("X", "Polna", 1.0, 2.0, 30.0, None)


def test_synthetic_is_reproducible(spark, tmp_path):
    a = registers.synthetic_panel(spark, 100)
    assert a.collect() == registers.synthetic_panel(spark, 100).collect() != registers.synthetic_panel(spark, 100, seed=8).collect()
    for kind in ("parquet", "csv"):
        registers.write_table(a, str(tmp_path / f"p.{kind}"))
    assert cli.main(["compare", str(tmp_path / "p.parquet"), str(tmp_path / "p.parquet")]) == 0
    assert cli.main(["validate", str(tmp_path / "p.parquet")]) == 0


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert streams.event_windows(events).agg(F.sum("n")).first()[0] == events.count()
    base = registers.synthetic_panel(spark, 50)
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    q = streams.watch_editions(stream, base, str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["status_changes"] == 0


def test_street_lists(spark, tmp_path):
    from tallyloom.sources import publishers

    texts = {"a": '["Polna", "Leśna"]', "b": '{"ulice": [{"nazwa": "Polna", "lat": 1.5, "lon": 2.5}]}', "c": '{"streets": {"Polna": {"lat": 1.5, "lon": 2.5}, "Leśna": null}}'}
    got = {}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        got[name] = sorted(tuple(r) for r in publishers.street_list(spark, str(tmp_path / f"{name}.json")).collect())
    assert got["a"] == [("Leśna", None, None), ("Polna", None, None)] and got["b"] == [("Polna", 1.5, 2.5)] and got["c"] == [("Leśna", None, None), ("Polna", 1.5, 2.5)]
