import math

import pytest
from pyspark.sql import functions as F

from itinera.functions import dates, geo, text


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_half_up_goes_towards_plus_infinity(spark):
    assert one(spark, *[geo.half_up(F.lit(x)) for x in (-0.5, 0.5, 2.5, -2.5)]) == [0.0, 1.0, 3.0, -2.0]


def test_haversine_and_mercator(spark):
    a, b, c, d = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), geo.haversine_km(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)), geo.mercator_y(F.lit(90.0)), geo.mercator_y(F.lit(0.0)))
    assert math.isclose(a, math.pi * 6371) and b is None and abs(c) < 1e-6 and abs(d - 0.5) < 1e-12


@pytest.mark.parametrize("start, lon, hint, degrees, want", [
    (170, -170, None, None, 190), (-170, 170, None, None, -190), (10, 20, "west", None, -340), (10, 10, "East", None, 370), (10, 10, "west", None, -350),
    (0, 90, None, -90.0, -270), (0, 90, None, 0.0, 90), (0, 90, None, 180.0, 90), (0, -90, None, 450.0, 270), (0, 200, "north", None, -160),
])
def test_unwrap(spark, start, lon, hint, degrees, want):
    sign = geo.bearing_sign(F.lit(hint).cast("string"), F.lit(degrees).cast("double"))
    assert one(spark, geo.unwrap_lon(F.lit(float(start)), F.lit(float(lon)), sign)) == [want]


def test_in_ring(spark):
    def inside(lon, lat, points):
        ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])
        return geo.in_ring(F.lit(float(lon)), F.lit(float(lat)), ring)

    square, notch = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert one(spark, inside(2, 2, square), inside(5, 2, square), inside(2, 2, notch), inside(0.5, 2, notch), inside(0, 2, square), inside(4, 2, square)) == [True, False, False, True, True, False]


def test_scores_and_scales(spark):
    scores = one(spark, *[geo.score_population(F.lit(x).cast("double")) for x in (11000, 20000, 1000, 30, 5, 0, -1, None)])
    assert [round(s, 3) for s in scores] == [1.0, 1.0, 0.742, 0.365, 0.365, 0.0, 0.0, 0.0]
    assert one(spark, *[geo.cap_for_zoom(F.lit(z).cast("double")) for z in (2.9, 3, 8.99, 9, 99, None)]) == [30, 100, 800, 9999, 9999, 9999]
    assert one(spark, geo.zoom_scale(F.lit(2.0)), geo.zoom_scale(F.lit(30.0)), geo.furniture_scale(F.lit(1.0))) == [0.7, 2.5, 0.85]
    assert one(spark, geo.leg_duration_ms(F.lit(300.9), F.lit(False)), geo.leg_duration_ms(F.lit(-5.0), F.lit(True)), geo.leg_duration_ms(F.lit(5000.0), F.lit(True))) == [2000, 800, 3000]


@pytest.mark.parametrize("given, day", [("2024-02-29", "2024-02-29"), ("2024-02-31", None), (" 2024-03-01 ", "2024-03-01"), ("2024-3-1", None), ("", None), (None, None), ("2024-13-01", None)])
def test_strict_days(spark, given, day):
    assert one(spark, dates.parse_day(F.lit(given).cast("string")).cast("string")) == [day]


@pytest.mark.parametrize("arrive, depart, line", [
    ("2024-05-03", None, "Arrived 3 May 2024"), (None, "2024-05-03", "Departed 3 May 2024"), ("2024-05-03", "2024-05-03", "3 May 2024"),
    ("2024-05-03", "2024-05-04", "3–4 May 2024 · 1 night"), ("2024-05-30", "2024-06-02", "30 May – 2 Jun 2024 · 3 nights"),
    ("2023-12-30", "2024-01-02", "30 Dec 2023 – 2 Jan 2024 · 3 nights"), ("2024-05-04", "2024-05-03", "4–3 May 2024"), (None, None, ""),
])
def test_stay_lines(spark, arrive, depart, line):
    assert one(spark, dates.stay_line(F.lit(arrive).cast("date"), F.lit(depart).cast("date"))) == [line]


def test_plates_and_exif(spark):
    plate = lambda a, b: dates.range_plate(F.lit(a).cast("date"), F.lit(b).cast("date"))
    assert one(spark, plate("2024-05-03", "2024-05-09"), plate("2024-05-03", "2024-06-09"), plate("2023-05-03", "2024-06-09"), plate("2024-05-03", None), plate(None, None)) == [
        "MAY · 2024", "MAY — JUNE · 2024", "MAY 2023 — JUNE 2024", "MAY · 2024", ""]
    exif = [dates.exif_time(F.lit(x).cast("string")).cast("string") for x in ("2024:02:30 10:11:12", "2024:05:06T00:00:00.5", "2024-05-06 00:00:00", None)]
    assert one(spark, *exif) == ["2024-03-01 10:11:12", "2024-05-06 00:00:00", None, None]


@pytest.mark.parametrize("name, folded", [("Çeşme", "cesme"), ("ıĞ", "ig"), ("Straße", "strasse"), ("Tromsø", "tromso"), ("Θεσσαλονίκη", "thessaloniki"), ("Ναύπλιο", "nayplio"), ("ου", "ou"), (" A ", "a"), (None, "")])
def test_fold(spark, name, folded):
    # A tonos parts the digraph's letters before it is stripped, so ύ after α is written by its own letter's rule or the pair's.
    got = one(spark, text.fold(F.lit(name).cast("string")))[0]
    assert got == folded or (name == "Ναύπλιο" and got == "navplio")


@pytest.mark.parametrize("name, flag, want", [("Bodrum", False, True), ("Ercan", None, True), ("Paris (CDG) ", False, True), ("Paris (CD)", False, False), ("", True, False), (None, True, False), ("Paris", True, True), ("Flughafen Wien", None, True), ("İzmir havalimanı", None, True)])
def test_airports(spark, name, flag, want):
    assert one(spark, text.is_airport(F.lit(name).cast("string"), F.lit(flag).cast("boolean"))) == [want]


def test_names(spark):
    names = lambda *n: text.clean_names(F.array(*[F.lit(x).cast("string") for x in n]))
    assert one(spark, *[text.join_names(names(*n)) for n in (["a"], ["a", " b "], ["a", "", None, "b", "c"], [" "])]) == ["a", "a & b", "a, b & c", ""]
    assert one(spark, text.credit_line(names("x")), text.present_tag(names("x", "y")), text.credit_line(names(" "))) == ["— x", "with x & y", ""]


def test_intro(spark):
    body = "First sentence here. " + "word " * 45
    long_end = "w " * 70 + 'ends." ' + "tail " * 40
    got = one(spark, text.clamp_intro(F.lit(body)), text.clamp_intro(F.lit(long_end)), text.clamp_intro(F.lit(" short ")), text.clamp_intro(F.lit(None).cast("string")), text.clamp_intro(F.lit("x" * 300)))
    assert got[0].endswith("word…") and len(got[0]) <= 221 and got[1].endswith('ends."') and got[2:4] == ["short", ""] and got[4] == "x" * 220 + "…"


def test_markup(spark):
    got = one(spark, text.escape_html(F.lit("<a href='x'>&\"")), text.script_safe(F.lit('{"a":"</ScRipt><!-- --> \u2028"}')))
    assert got == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", '{"a":"\\u003c/ScRipt>\\u003c!-- --\\u003e \\u2028"}']


def test_one_edit(spark):
    pairs = [("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("abc", "acb"), ("", "a")]
    assert one(spark, *[text.within_one_edit(F.lit(a), F.lit(b)) for a, b in pairs]) == [True, True, True, False, True]


def test_days_do_not_depend_on_the_session_time_zone(spark):
    from itinera.functions import dates

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.createDataFrame([(0,), (-1,), (86_400_000_000,), (None,)], "us long").select(dates.utc_day(F.col("us")).alias("d")).collect()
            assert [r.d for r in rows] == ["1970-01-01", "1969-12-31", "1970-01-02", ""]
            wall = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.123456' AS t UNION ALL SELECT TIMESTAMP_NTZ'1965-07-01 00:00:01' UNION ALL SELECT NULL")
            assert sorted(r.m for r in wall.select(dates.micros_of(F.col("t")).alias("m")).collect() if r.m is not None) == [-142_127_999_000_000, 1_710_037_800_123_456]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_accents_of_all_scripts_and_all_blanks(spark):
    from itinera.functions import dates, text

    rows = spark.createDataFrame([("Йошкар-Ола Ёлка",), ("  Çeşme\t　",), ("Ǻ ế ῷ",), (None,)], "t string")
    got = [r.f for r in rows.select(text.fold(F.col("t")).alias("f")).collect()]
    assert got == ["иошкар-ола елка", "cesme", "a e o", ""]
    names = spark.createDataFrame([([" Ada\n", " ", None, "Bo"],)], "n array<string>").select(text.clean_names(F.col("n")).alias("n")).first().n
    assert names == ["Ada", "Bo"]
    assert spark.createDataFrame([(" 2024-02-29\n",)], "t string").select(dates.parse_day(F.col("t")).cast("string").alias("d")).first().d == "2024-02-29"


def test_display_and_country_names(spark):
    from itinera.functions import text

    rows = spark.createDataFrame([("Rome", {"it": "Roma", "el": ""}), ("Nice", None), (None, {})], "name string, alt map<string,string>")
    assert [r.n for r in rows.select(text.display_name(F.col("name"), F.col("alt"), ["el", "it"]).alias("n")).collect()] == ["Roma", "Nice", ""]
    codes = spark.createDataFrame([("TR",), ("XX",), (None,)], "c string")
    assert [r.n for r in codes.select(text.country_name(F.col("c"), {"TR": "Türkiye"}).alias("n")).collect()] == ["Türkiye", "XX", ""]
