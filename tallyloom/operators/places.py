"""Place descriptions against a gazetteer: a cascade of strategies, each a join over the distinct descriptions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import plain, strip

# Words that name a kind of street or a title, and what a station's code looks like.
STOP = (
    "ul", "ulica", "al", "aleja", "aleje", "pl", "plac", "os", "osiedle", "rondo", "sw", "swietego", "swietej", "im", "imienia", "gen", "generala", "gen.",
    "ks", "ksiedza", "dr", "prof", "mjr", "plk", "kpt", "por", "mjra", "marsz", "marszalka", "bp", "biskupa", "kard", "kardynala", "droga", "trakt", "skwer",
    "bulwar", "park", "most", "wybrzeze", "brak", "dzialka", "nr", "dz", "obreb",
)
CODE = "^[A-ZĄĆĘŁŃÓŚŻŹ]{2,5}[0-9]{0,2}$"


def normalize(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(plain(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: (w != "") & ~w.isin(*STOP) & ~w.rlike("^[0-9]+$"))


def gazetteer(streets: DataFrame) -> DataFrame:
    """streets (name, lat, lon, _seq; axis, an array of lat/lon structs, if known; locality, if there are several) with place (the normalized locality, or empty), norm and set (sorted words); of equal norms of a place the first."""
    place = normalize(F.col("locality")) if "locality" in streets.columns else F.lit("")
    own = streets.withColumns({"norm": normalize(F.col("name")), "place": place})
    first = own.groupBy("place", "norm").agg(F.min_by(F.struct("name", "lat", "lon", *(["axis"] if "axis" in streets.columns else [])), "_seq").alias("r"), F.min("_seq").alias("_seq"))
    return first.select("place", "norm", "r.*", "_seq", F.array_sort(F.array_distinct(words(F.col("norm")))).alias("set"))


def _only(hits: DataFrame, name: str) -> DataFrame:
    """Of (place, street, name) hits, the descriptions with a single name."""
    return hits.groupBy("place", "street").agg(F.count_distinct("name").alias("n"), F.min("name").alias(name)).where("n = 1").drop("n")


def resolve(queries: DataFrame, gaz: DataFrame, column: str = "query") -> DataFrame:
    """query, matched, lat, lon, confidence, reason, accuracy for each distinct description, by a gazetteer without localities.

    The strategies are EXACT, UNIQUE_TOKEN, TOKEN_SUBSET, REVERSED and INTERSECTION, in that order; a description whose
    words are mostly not those of the street found is verbal, which does not stop the later strategies. An intersection
    lies where the axes of its first two streets cross, if the gazetteer has both axes; else at the first street's point.
    """
    asked = queries.select(F.lit("").alias("place"), strip(F.coalesce(column, F.lit(""))).alias("query")).distinct()
    return _resolve(asked, gaz).drop("place")


def _resolve(q: DataFrame, gaz: DataFrame, codes: bool = True) -> DataFrame:
    """q has distinct place and query; codes: whether a description may be a station's code."""
    q = q.withColumn("street", F.when(F.contains("query", F.lit(",")), F.expr("substr(query, instr(query, ',') + 1)")).otherwise(F.col("query")))
    # the parts of "A / B" go through the same cascade, as descriptions of their own
    pieces = F.filter(F.transform(F.split("street", r"[/\\]"), strip), lambda x: x != "")
    whole = F.array(F.struct(F.lit(0).alias("no"), F.col("query").alias("key"), F.col("street").alias("of")))
    parts = F.when(F.size(pieces) > 1, F.transform(pieces, lambda x, i: F.struct((i + 1).alias("no"), x.alias("key"), x.alias("of")))).otherwise(F.array().cast("array<struct<no:int,key:string,of:string>>"))
    rows = q.select("place", "query", F.explode(F.concat(whole, parts)).alias("p")).select("place", "query", "p.*")
    done = _cascade(rows.select("place", F.col("key").alias("query"), F.col("of").alias("street")).distinct(), gaz, codes)
    each = rows.join(done.select("place", F.col("query").alias("key"), F.col("street").alias("of"), "matched", "lat", "lon", "confidence", "reason", "stop"), ["place", "key", "of"])
    result = F.struct("matched", "lat", "lon", "confidence", "reason", "stop")
    both = each.groupBy("place", "query").agg(
        F.max(F.when(F.col("no") == 0, result)).alias("r"),
        F.count_if(F.col("no") > 0).alias("parts"),
        F.array_sort(F.collect_list(F.when((F.col("no") > 0) & F.col("matched").isNotNull(), F.struct("no", "matched", "lat", "lon")))).alias("h"),
    )
    crossing = (F.col("r.confidence") == "NONE") & ~F.col("r.stop") & (F.size("h") >= 2)
    pick = lambda c, x: F.when(crossing, x).otherwise(F.col(f"r.{c}")).alias(c)
    out = both.select(
        "place",
        "query",
        pick("matched", F.array_join(F.transform("h", lambda x: x["matched"]), " / ")),
        pick("lat", F.get("h", F.lit(0))["lat"]),
        pick("lon", F.get("h", F.lit(0))["lon"]),
        pick("confidence", F.lit("INTERSECTION")),
        pick("reason", F.format_string("matched %d of %d parts", F.size("h"), "parts")),
        F.when(crossing, F.struct("place", F.get("h", F.lit(0))["matched"].alias("a"), F.get("h", F.lit(1))["matched"].alias("b"))).alias("streets"),
    )
    accuracy = F.when(F.col("matched").isNull(), F.lit(None)).when(F.col("lat").isNotNull(), "STREET_AXIS_POINT").otherwise("NO_GEOMETRY")
    out = out.withColumn("accuracy", accuracy)
    return (_at_crossing(out, gaz) if "axis" in gaz.columns else out).drop("streets")


def _at_crossing(out: DataFrame, gaz: DataFrame) -> DataFrame:
    """Intersections moved to where their streets' axes cross; each pair of streets is computed once."""
    axes = gaz.where("size(axis) > 1").select("place", "name", "axis")
    pairs = out.where("streets IS NOT NULL").select("streets").distinct().select(F.col("streets").alias("id"), "streets.*")
    both = pairs.join(axes.select("place", F.col("name").alias("a"), F.col("axis").alias("axis_a")), ["place", "a"]).join(axes.select("place", F.col("name").alias("b"), F.col("axis").alias("axis_b")), ["place", "b"])
    point = axis_crossing(both).select("id", F.struct("lat", "lon").alias("point"))
    at = both.select("id").join(point, "id", "left").select(F.col("id").alias("streets"), "point", F.lit(True).alias("axes"))
    met = F.col("point").isNotNull()
    apart = F.coalesce("axes", F.lit(False)) & ~met
    return out.join(at, "streets", "left").select(
        "streets",
        "place",
        "query",
        "matched",
        F.when(met, F.col("point.lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(met, F.col("point.lon")).otherwise(F.col("lon")).alias("lon"),
        "confidence",
        F.when(apart, F.concat("reason", F.lit("; the axes do not intersect, point taken from the first part"))).otherwise(F.col("reason")).alias("reason"),
        F.when(met, "INTERSECTION_POINT").otherwise(F.col("accuracy")).alias("accuracy"),
    )


def _streets_with(asked: DataFrame, token: DataFrame, alone: DataFrame) -> DataFrame:
    """place, street, need, name, set: the gazetteer's streets that have every word of need. Only the rarest word of each is looked up, then the whole set is compared, so common words do not multiply."""
    each = asked.select("place", "street", "need", F.explode("need").alias("t")).join(alone.select("place", "t", "n"), ["place", "t"])
    rare = each.groupBy("place", "street", "need").agg(F.count(F.lit(1)).alias("m"), F.min_by("t", F.struct("n", "t")).alias("t")).where(F.col("m") == F.size("need"))
    return rare.join(token, ["place", "t"]).where(F.size(F.array_except("need", "set")) == 0).select("place", "street", "need", "name", "set")


def _cascade(q: DataFrame, gaz: DataFrame, codes: bool = True) -> DataFrame:
    """q has place, query and street; each street of a place is looked up once."""
    asked = q.select("place", "street").distinct().withColumns({"norm": normalize(F.col("street")), "norm_nr": normalize(F.substring_index("street", " nr ", 1))}).withColumn("ts", words(F.col("norm")))
    names = gaz.select("place", "norm", "name")
    exact = asked.join(names, ["place", "norm"]).select("place", "street", F.col("name").alias("exact"))
    exact_nr = asked.select("place", "street", F.col("norm_nr").alias("norm")).join(names, ["place", "norm"]).select("place", "street", F.col("name").alias("exact_nr"))
    token = gaz.select("place", "name", "set", F.explode("set").alias("t"))
    alone = token.groupBy("place", "t").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    need = asked.select("place", "street", "ts", F.array_distinct("ts").alias("need"))
    hits = need.select("place", "street", F.explode("need").alias("t")).join(alone, ["place", "t"])
    seen = hits.groupBy("place", "street").agg(F.count(F.lit(1)).alias("known"))
    unique = _only(hits.where("n = 1"), "unique_name")
    subset = _only(_streets_with(need, token, alone), "subset_name")
    # reversed: all full words are the street's, and short ones begin one of its words
    full = need.withColumn("need", F.filter("need", lambda t: F.length(t) > 2)).where("size(need) > 0")
    pool = _streets_with(full, token, alone).join(asked.select("place", "street", "ts"), ["place", "street"])
    pool = pool.where(F.forall(F.filter("ts", lambda t: F.length(t) <= 2), lambda i: F.exists("set", lambda s: F.startswith(s, i))))
    same = pool.where(F.array_sort(F.array_distinct("ts")) == F.col("set"))
    rev = _only(same, "rev_same").join(_only(pool, "rev_any"), ["place", "street"], "full_outer").select("place", "street", F.coalesce("rev_same", "rev_any").alias("rev"))
    out = asked
    for side in (exact, exact_nr, unique, subset, rev, seen):
        out = out.join(side, ["place", "street"], "left")
    sets = gaz.select("place", "name", "set", "lat", "lon")

    def verbal(name: str) -> Column:
        """At least four words, fewer than half of them the street's or the beginning of one of its words (or the other way round)."""
        explained = F.size(F.filter("ts", lambda t: F.exists(f"set_{name}", lambda s: F.startswith(s, t) | F.startswith(t, s))))
        return F.coalesce((F.size("ts") >= 4) & (explained < 0.5 * F.size("ts")), F.lit(False))

    for c in ("unique_name", "subset_name", "rev"):
        out = out.join(sets.select("place", F.col("name").alias(c), F.col("set").alias(f"set_{c}")), ["place", c], "left")
    out = q.join(out, ["place", "street"])
    tries = [(c, how) for c, how in (("unique_name", "UNIQUE_TOKEN"), ("subset_name", "TOKEN_SUBSET"), ("rev", "REVERSED"))]
    is_code = F.col("query").rlike(CODE) if codes else F.lit(False)
    empty = F.col("query") == ""
    stop = empty | is_code
    best = F.when(stop, F.lit(None)).when(F.col("exact").isNotNull() | F.col("exact_nr").isNotNull(), F.struct(F.coalesce("exact", "exact_nr").alias("name"), F.lit("EXACT").alias("how")))
    for c, how in tries:
        best = best.when(F.col(c).isNotNull() & ~verbal(c), F.struct(F.col(c).alias("name"), F.lit(how).alias("how")))
    rejected = F.lit(False)
    for c, _ in tries:
        rejected = rejected | (F.col(c).isNotNull() & verbal(c))
    out = out.withColumns({"best": best, "rejected": rejected})
    reason = F.when(empty, "empty_description").when(is_code, "station_code_without_dictionary").when(F.col("best").isNotNull(), F.lit(None)).when(F.size("ts") == 0, "no_distinguishing_tokens").when(F.col("rejected"), "verbal_description_not_street_name").when(F.col("known").isNull(), "no_candidates").otherwise("multiple_candidates")
    done = out.select("place", "query", "street", F.col("best.name").alias("matched"), F.coalesce("best.how", F.lit("NONE")).alias("confidence"), reason.alias("reason"), (stop | (F.size("ts") == 0)).alias("stop"))
    points = sets.select("place", F.col("name").alias("matched"), "lat", "lon")
    return done.join(points, ["place", "matched"], "left")


def route(queries: DataFrame, localities: DataFrame, column: str = "query", default: str | None = None) -> DataFrame:
    """query, locality, street, routed: the gazetteer's locality that the text before the first comma names (localities: name).

    The first word of a longer name stands for it where no other name has that word in front; where several have,
    routed is ambiguous_locality with the normalized names. Text without a comma belongs to default, if one is given.
    """
    q = queries.select(F.col(column).alias("query")).distinct()
    comma = F.contains("query", F.lit(","))
    head = F.when(comma, normalize(F.substring_index("query", ",", 1))).otherwise("")
    street = strip(F.when(comma, F.expr("substr(query, instr(query, ',') + 1)")).otherwise(F.col("query")))
    q = q.withColumns({"head": F.coalesce(F.nullif(head, F.lit("")), normalize(F.lit(default)) if default else F.lit(None)), "street": street})
    known = localities.select(normalize(F.col("name")).alias("head"), "name").groupBy("head").agg(F.min("name").alias("locality"))
    # one list for each first word, of localities that share it
    first = known.where(F.contains("head", F.lit(" "))).groupBy(F.substring_index("head", " ", 1).alias("head")).agg(F.min("locality").alias("locality"), F.array_sort(F.collect_list("head")).alias("all"))
    several = F.size("all") > 1
    alias = first.join(known.select("head"), "head", "left_anti").select("head", F.when(~several, F.col("locality")).alias("locality"), F.when(several, F.array_join("all", "|")).alias("several"))
    out = q.join(known.withColumn("several", F.lit(None).cast("string")).unionByName(alias), "head", "left")
    said = F.when(F.col("head").isNull(), "no_locality_declared").when(F.col("several").isNotNull(), F.concat(F.lit("ambiguous_locality:"), "several")).when(F.col("locality").isNull(), "locality_not_in_gazetteer").otherwise("routed")
    return out.select("query", "locality", "street", said.alias("routed"))


def house_number(c: Column) -> tuple[Column, Column]:
    """The street and the number at the end of a description (12, 85A, 12/14); the number is null if there is none."""
    rx = r"^(.*?)\s+(\d+\s*[A-Za-z]?(?:\s*/\s*\d+\s*[A-Za-z]?)?)\s*$"
    number = F.regexp_replace(F.regexp_extract(c, rx, 2), r"\s+", "")
    return F.when(number != "", strip(F.regexp_extract(c, rx, 1))).otherwise(c), F.nullif(number, F.lit(""))


def resolve_in(queries: DataFrame, gaz: DataFrame, localities: DataFrame, addresses: DataFrame | None = None, default: str | None = None, allow_centroid: bool = False, column: str = "query") -> DataFrame:
    """query, locality, matched, lat, lon, confidence, reason, accuracy by a gazetteer of several localities.

    Each distinct description is routed (see route), then its street is resolved among those of its locality. A number
    at the end is a house number where the text before it finds the same street, or a street where the whole finds
    none; if addresses (locality, street, number, lat, lon) has that number, its point is taken (ADDRESS_POINT).
    With allow_centroid, what is routed but not found lies at the locality's lat and lon (LOCALITY_CENTROID).
    """
    routed = route(queries.select(strip(F.coalesce(column, F.lit(""))).alias("query")), localities, default=default)
    empty, is_code = F.col("query") == "", F.col("query").rlike(CODE)
    reached = ~empty & ~is_code & (F.col("routed") == "routed")
    rest, number = house_number(F.col("street"))
    q = routed.withColumns({"place": F.when(reached, normalize(F.col("locality"))), "number": number}).withColumn("rest", F.when(F.col("number").isNotNull(), rest))
    # the whole street and what is left without the number are looked up together
    looked = F.array_compact(F.array(F.struct(F.lit(False).alias("cut"), F.col("street").alias("text")), F.when(F.col("rest").isNotNull(), F.struct(F.lit(True).alias("cut"), F.col("rest").alias("text")))))
    texts = q.where("place IS NOT NULL").select("place", "query", F.explode(looked).alias("l")).select("place", "query", "l.*")
    done = _resolve(texts.select("place", F.col("text").alias("query")).distinct(), gaz, codes=False)
    found = F.struct("matched", "lat", "lon", "confidence", "reason", "accuracy")
    each = texts.join(done.select("place", F.col("query").alias("text"), found.alias("found")), ["place", "text"])
    both = each.groupBy("query").agg(F.max(F.when(~F.col("cut"), F.col("found"))).alias("whole"), F.max(F.when(F.col("cut"), F.col("found"))).alias("cut"))
    both = q.join(both, "query", "left")
    taken = F.coalesce(F.col("cut.matched").isNotNull() & (F.col("whole.matched").isNull() | (F.col("cut.matched") == F.col("whole.matched"))), F.lit(False))
    out = both.select("query", "routed", "locality", "place", F.when(taken & F.col("whole.matched").isNull(), F.col("cut")).otherwise(F.col("whole")).alias("r"), F.when(taken, F.col("number")).alias("number"))
    out = out.withColumns({"at_street": normalize(F.col("r.matched")), "at_number": normalize(F.col("number"))})
    if addresses is None:
        out = out.withColumn("address", F.lit(None).cast("struct<lat:double,lon:double>"))
    else:
        keys = {"place": normalize(F.col("locality")), "at_street": normalize(F.col("street")), "at_number": normalize(F.col("number"))}
        points = addresses.select(*[c.alias(n) for n, c in keys.items()], F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("p"))
        out = out.join(points.groupBy(*keys).agg(F.max("p").alias("address")), list(keys), "left")
    hit = F.col("r.matched").isNotNull() & F.col("number").isNotNull() & F.col("address").isNotNull()
    lost = F.lit(False)
    if allow_centroid and {"lat", "lon"} <= set(localities.columns):
        centre = localities.groupBy(normalize(F.col("name")).alias("place")).agg(F.min(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))).alias("centre"))
        out = out.join(centre, "place", "left")
        lost = F.col("place").isNotNull() & F.col("r.matched").isNull() & F.col("centre").isNotNull()
    else:
        out = out.withColumn("centre", F.lit(None).cast("struct<lat:double,lon:double>"))
    pick = lambda c: F.when(hit, F.col(f"address.{c}")).when(lost, F.col(f"centre.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    reason = F.when(empty, "empty_description").when(is_code, "station_code_without_dictionary").when(F.col("place").isNull(), F.col("routed")).when(hit, F.concat(F.lit("house_number="), "number")).otherwise(F.col("r.reason"))
    accuracy = F.when(hit, "ADDRESS_POINT").when(lost, "LOCALITY_CENTROID").otherwise(F.col("r.accuracy"))
    return out.select("query", "locality", F.col("r.matched").alias("matched"), pick("lat"), pick("lon"), F.coalesce("r.confidence", F.lit("NONE")).alias("confidence"), reason.alias("reason"), accuracy.alias("accuracy"))


@dataclass(frozen=True)
class Gazetteer:
    """A resolver: what geocode takes in place of resolved descriptions. Any object with resolve_df(df, column) is one."""

    streets: DataFrame

    def resolve_df(self, df: DataFrame, column: str) -> DataFrame:
        return resolve(df, gazetteer(self.streets), column)


@dataclass(frozen=True)
class Localities:
    """A resolver over several localities, see resolve_in."""

    streets: DataFrame
    localities: DataFrame
    addresses: DataFrame | None = None
    default: str | None = None
    allow_centroid: bool = False

    def resolve_df(self, df: DataFrame, column: str) -> DataFrame:
        return resolve_in(df, gazetteer(self.streets), self.localities, self.addresses, self.default, self.allow_centroid, column)


def geocode(df: DataFrame, resolved, column: str = "location_text", overwrite: bool = False, station_code_column: str | None = None) -> DataFrame:
    """df with coordinates, _geo_confidence, _geo_accuracy, _geo_reason; the source's own coordinates stay unless overwritten.

    resolved: a table as resolve gives it, or a resolver, which then looks up the distinct descriptions. Rows whose
    station_code_column is true are codes of stations, whatever they look like.
    """
    if hasattr(resolved, "resolve_df"):
        resolved = resolved.resolve_df(df.select(column).distinct(), column)
    own = F.coalesce(F.col("coordinates"), F.lit("")) != "" if "coordinates" in df.columns else F.lit(False)
    keep = own & F.lit(not overwrite)
    code = F.coalesce(F.col(station_code_column), F.lit(False)) if station_code_column in df.columns else F.lit(False)
    r = resolved.select(F.col("query").alias("_tl_query"), "lat", "lon", "confidence", "accuracy", "reason")
    joined = df.join(r, strip(F.coalesce(F.col(column), F.lit(""))) == F.col("_tl_query"), "left")
    point = F.when(F.col("lat").isNotNull() & ~code, F.format_string("%.6f,%.6f", "lat", "lon"))
    source = F.col("coordinates") if "coordinates" in df.columns else F.lit(None).cast("string")
    said = lambda c, coded: F.when(code, coded).otherwise(F.col(c))
    return joined.withColumns({"coordinates": F.when(keep, source).otherwise(point), "_geo_confidence": F.when(keep, "SOURCE").otherwise(said("confidence", F.lit("NONE"))), "_geo_accuracy": F.when(keep, "SOURCE").otherwise(said("accuracy", F.lit(None))), "_geo_reason": F.when(keep, F.lit(None)).otherwise(said("reason", F.lit("station_code_without_dictionary")))}).drop("_tl_query", "lat", "lon", "confidence", "accuracy", "reason")


def summarize(resolved: DataFrame) -> DataFrame:
    """level (confidence, accuracy or reason), value, n."""
    pairs = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in ("confidence", "accuracy", "reason")])
    return resolved.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL").groupBy("level", "value").agg(F.count(F.lit(1)).alias("n"))


def axis_crossing(pairs: DataFrame) -> DataFrame:
    """id, lat, lon of the first crossing of two axes. pairs: id, axis_a, axis_b (arrays of lat/lon structs).

    The segments of both axes are laid on a grid of their mean extent, each on the cells that it passes, which are about
    as many as there are segments; only segments that share a cell are tested.
    """
    scale = F.cos(F.radians((F.aggregate("axis_a", F.lit(0.0), lambda s, p: s + p["lat"]) + F.aggregate("axis_b", F.lit(0.0), lambda s, p: s + p["lat"])) / (F.size("axis_a") + F.size("axis_b"))))
    both = pairs.where("size(axis_a) > 1 AND size(axis_b) > 1").withColumn("scale", scale)
    # steps along an axis, as how far they go east and north together
    extent = lambda c: F.aggregate(F.sequence(F.lit(2), F.size(c)), F.lit(0.0), lambda s, i: s + F.abs(F.element_at(c, i)["lat"] - F.element_at(c, i - 1)["lat"]) + F.abs(F.element_at(c, i)["lon"] - F.element_at(c, i - 1)["lon"]) * F.col("scale"))
    cell = (extent("axis_a") + extent("axis_b")) / (F.size("axis_a") + F.size("axis_b") - 2)
    both = both.withColumn("cell", F.coalesce(F.nullif(cell, F.lit(0.0)), F.lit(1.0)))

    def laid(axis: str, i: str, s: str) -> DataFrame:
        steps = F.zip_with(F.slice(axis, 1, F.size(axis) - 1), F.slice(axis, 2, F.size(axis) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        each = both.select("id", "scale", "cell", F.posexplode(steps).alias(i, s))
        x = lambda p: F.col(f"{s}.{p}.lon") * F.col("scale")
        y = lambda p: F.col(f"{s}.{p}.lat")
        # a little wider than the segment, so that rounding loses no cell
        pad = F.col("cell") * 1e-6
        left, right = F.least(x("p"), x("q")), F.greatest(x("p"), x("q"))
        columns = F.sequence(F.floor((left - pad) / F.col("cell")), F.floor((right + pad) / F.col("cell")))
        each = each.withColumn("cx", F.explode(columns))
        slope = F.try_divide(y("q") - y("p"), F.nullif(x("q") - x("p"), F.lit(0.0)))
        at = lambda edge: F.coalesce(y("p") + (F.greatest(left, F.least(right, edge)) - x("p")) * slope, y("p"))
        first, last = at(F.col("cx") * F.col("cell") - pad), F.when(slope.isNull(), y("q")).otherwise(at((F.col("cx") + 1) * F.col("cell") + pad))
        rows = F.sequence(F.floor((F.least(first, last) - pad) / F.col("cell")), F.floor((F.greatest(first, last) + pad) / F.col("cell")))
        return each.withColumn("cy", F.explode(rows)).drop("cell")

    ab = laid("axis_a", "i", "s").join(laid("axis_b", "j", "t").drop("scale"), ["id", "cx", "cy"])
    x = lambda p: p["lon"] * F.col("scale")
    y = lambda p: p["lat"]
    s, t = F.col("s"), F.col("t")
    dx, dy, ex, ey = x(s["q"]) - x(s["p"]), y(s["q"]) - y(s["p"]), x(t["q"]) - x(t["p"]), y(t["q"]) - y(t["p"])
    det = dx * ey - dy * ex
    u = F.try_divide((x(t["p"]) - x(s["p"])) * ey - (y(t["p"]) - y(s["p"])) * ex, F.nullif(det, F.lit(0.0)))
    v = F.try_divide((x(t["p"]) - x(s["p"])) * dy - (y(t["p"]) - y(s["p"])) * dx, F.nullif(det, F.lit(0.0)))
    hit = ab.withColumns({"u": u, "v": v}).where("u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1")
    point = F.struct((y(F.col("s.p")) + F.col("u") * (y(F.col("s.q")) - y(F.col("s.p")))).alias("lat"), (F.col("s.p.lon") + F.col("u") * (F.col("s.q.lon") - F.col("s.p.lon"))).alias("lon"))
    return hit.groupBy("id").agg(F.min_by(point, F.struct("i", "j")).alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))
