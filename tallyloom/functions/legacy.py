"""Frames with the older (Polish) column names and codes, in today's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Older names of columns and codes.
COLUMNS = {
    "id_wniosku": "application_id", "id_wezla": "node_id", "nazwa_wezla": "node_name", "lokalizacja_tekst": "location_text", "wspolrzedne": "coordinates", "poziom_napiecia": "voltage_level",
    "klasa_zasobu": "resource_class", "moc_wprowadzana": "capacity_injected", "moc_pobierana": "capacity_withdrawn", "moc_dostepna": "capacity_available", "moc_zarezerwowana": "capacity_reserved",
    "status_procesu": "process_status", "data_wniosku": "date_application", "data_warunkow": "date_conditions", "data_odmowy": "date_refusal", "data_umowy": "date_agreement", "data_publikacji": "date_published",
    "wydawca": "publisher", "jurysdykcja": "jurisdiction", "dokument_zrodlowy": "source_document", "_encja": "_entity",
}
CODES = {"resource_class": {"FW": "WIND", "ODB": "LOAD", "INNE": "OTHER", "NIEOKRESLONE": "UNSPECIFIED"}, "process_status": {"WNIOSEK_ZLOZONY": "APPLICATION_FILED", "W_ANALIZIE": "UNDER_REVIEW", "WARUNKI_WYDANE": "CONDITIONS_ISSUED", "ODMOWA": "REFUSED", "PRZYLACZONY": "CONNECTED"}, "_entity": {"WNIOSEK": "APPLICATION", "WEZEL": "NODE"}}


def translate(df: DataFrame) -> DataFrame:
    """df in today's names and codes; a frame that has them already is unchanged, and so are numbers."""
    out = df.withColumnsRenamed({c: COLUMNS[c] for c in df.columns if c in COLUMNS and COLUMNS[c] not in df.columns})
    for c, codes in CODES.items():
        if c in out.columns and dict(out.dtypes)[c] == "string":
            table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
            out = out.withColumn(c, F.coalesce(table[F.col(c)], F.col(c)))
    return out
