"""Trip records: schema migrations, defaults, state, companions, privacy counts, layered sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itinera.functions.text import clean_names, intro_text, trimmed
from itinera.plans import dims


def _renamed(key: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def migrate_stores(stores: DataFrame) -> DataFrame:
    """Bring stores (store, version, theme, high_contrast, trips of (era, theme)) to version 2.

    Version 0 keys get their new names; version 1 turns the contrast theme into a
    setting. A store of a version that is not known stays as it is.
    """
    version = F.coalesce("version", F.lit(0))
    first = stores.withColumn("version", version).withColumns(
        {
            "trips": F.when(
                F.col("version") == 0,
                F.transform(
                    "trips",
                    lambda t: F.struct(_renamed(t["era"], dims.ERA_RENAMES).alias("era"), _renamed(t["theme"], dims.THEME_RENAMES).alias("theme")),
                ),
            ).otherwise(F.col("trips")),
            "theme": F.when(F.col("version") == 0, _renamed(F.col("theme"), dims.THEME_RENAMES)).otherwise(F.col("theme")),
            "version": F.when(F.col("version") == 0, 1).otherwise(F.col("version")),
        }
    )
    old = F.col("version") == 1
    seen = F.coalesce(F.exists("trips", lambda t: t["theme"].eqNullSafe("hc")), F.lit(False)) | F.col("theme").eqNullSafe("hc")
    theme = lambda t: F.when(t["theme"] == "hc", dims.CONTRAST_THEME).otherwise(t["theme"])
    return first.withColumn("_seen", old & seen).select(
        "store",
        F.when(old, 2).otherwise(F.col("version")).alias("version"),
        F.when(old & (F.col("theme") == "hc"), dims.DEFAULT_THEME).otherwise(F.col("theme")).alias("theme"),
        (F.coalesce("high_contrast", F.lit(False)) | F.col("_seen")).alias("high_contrast"),
        F.when(old, F.transform("trips", lambda t: F.struct(t["era"].alias("era"), theme(t).alias("theme")))).otherwise(F.col("trips")).alias("trips"),
    )


def theme_rows(df: DataFrame) -> DataFrame:
    """theme, owner: the era that declares each theme."""
    return dims.eras(df.sparkSession).select(F.explode("themes").alias("theme"), F.col("era").alias("owner"))


def available_themes(df: DataFrame) -> DataFrame:
    """era, theme, place: an era's own themes, then the universal ones that it lacks."""
    eras = dims.eras(df.sparkSession).select("era", F.posexplode("themes").alias("place", "theme"))
    universal = [(i + 100, t) for i, t in enumerate(dims.UNIVERSAL_THEMES)]
    extra = eras.select("era").distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("theme")) for i, t in universal])))
    extra = extra.select("era", "x.place", "x.theme").join(eras, ["era", "theme"], "left_anti")
    return eras.select("era", "theme", "place").unionByName(extra.select("era", "theme", "place"))


def boot_state(stored: DataFrame) -> DataFrame:
    """A sane era and theme for each row's stored ones: all columns, with boot_era, boot_theme.

    An unknown era is taken from the theme, or is the legacy one; a theme that the
    era does not offer becomes the era's default.
    """
    eras = dims.eras(stored.sparkSession).select(F.col("era").alias("_era"), F.col("themes")[0].alias("_default"))
    known = stored.join(F.broadcast(eras.select("_era")), F.col("era") == F.col("_era"), "left")
    owned = known.join(F.broadcast(theme_rows(stored).withColumnRenamed("theme", "_theme")), F.col("theme") == F.col("_theme"), "left")
    based = owned.withColumn("boot_era", F.coalesce("_era", "owner", F.lit(dims.LEGACY_ERA))).drop("_era", "_theme", "owner")
    offers = available_themes(stored).select(F.col("era").alias("_e"), F.col("theme").alias("_t"))
    offered = based.join(F.broadcast(offers), (F.col("boot_era") == F.col("_e")) & (F.col("theme") == F.col("_t")), "left")
    full = offered.join(F.broadcast(eras), F.col("boot_era") == F.col("_era"), "left")
    return full.withColumn("boot_theme", F.coalesce("_t", "_default")).drop("_e", "_t", "_era", "_default")


def fill_defaults(trips: DataFrame) -> DataFrame:
    """era and theme of trips where missing: the era from the theme, the theme from the era."""
    eras = dims.eras(trips.sparkSession).select(F.col("era").alias("_era"), F.col("themes")[0].alias("_default"))
    owners = theme_rows(trips).withColumnRenamed("theme", "_theme")
    based = trips.join(F.broadcast(owners), F.col("theme") == F.col("_theme"), "left")
    based = based.withColumn("era", F.coalesce(F.nullif("era", F.lit("")), "owner", F.lit(dims.LEGACY_ERA))).drop("owner", "_theme")
    full = based.join(F.broadcast(eras), F.col("era") == F.col("_era"), "left")
    theme = F.coalesce(F.nullif("theme", F.lit("")), "_default", F.lit(dims.DEFAULT_THEME))
    return full.withColumn("theme", theme).drop("_era", "_default")


def select_states(choices: DataFrame) -> DataFrame:
    """Fold era and theme choices in order: owner, era, theme after the last of them.

    choices: owner, ord, kind (``era`` or ``theme``), key. An era keeps the current
    theme if it offers it; a choice that is unknown or not offered changes nothing.
    """
    offers: dict[str, list[str]] = {}
    for era, *_, themes in dims.ERAS:
        offers[era] = [*themes, *[t for t in dims.UNIVERSAL_THEMES if t not in themes]]
    table = F.create_map(*[x for era, themes in offers.items() for x in (F.lit(era), F.array(*map(F.lit, themes)))])
    start = F.struct(F.lit(dims.LEGACY_ERA).alias("era"), F.lit(dims.DEFAULT_THEME).alias("theme"))

    def step(acc: Column, c: Column) -> Column:
        own, new = F.try_element_at(table, acc["era"]), F.try_element_at(table, c["key"])
        to_era = (c["kind"] == "era") & new.isNotNull()
        to_theme = (c["kind"] == "theme") & F.coalesce(F.array_contains(own, c["key"]), F.lit(False))
        return F.struct(
            F.when(to_era, c["key"]).otherwise(acc["era"]).alias("era"),
            F.when(to_era, F.when(F.array_contains(new, acc["theme"]), acc["theme"]).otherwise(new[0])).when(to_theme, c["key"]).otherwise(acc["theme"]).alias("theme"),
        )

    own = choices.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "key"))).alias("c"))
    return own.select("owner", F.aggregate("c", start, step).alias("s")).select("owner", "s.era", "s.theme")


def present(stops: DataFrame, trips: DataFrame) -> DataFrame:
    """Who is at each stop: its own names, else the trip's companions: trip, seq, names, source."""
    both = stops.join(trips.select("trip", "companions"), "trip", "left")
    own, shared = clean_names(F.col("present")), clean_names(F.col("companions"))
    source = F.when(F.size(own) > 0, "stop").when(F.size(shared) > 0, "trip")
    return both.select("trip", "seq", F.when(F.size(own) > 0, own).otherwise(shared).alias("names"), source.alias("source"))


def privacy_manifest(stops: DataFrame, trips: DataFrame, tier: str) -> DataFrame:
    """What a shared trip holds: trip, place, label, count, for counts above zero.

    stops: trip, photos, note, arrive, depart; trips: trip, companions (array). The
    public tier tells no notes and only approximate locations.
    """
    counted = stops.groupBy("trip").agg(
        F.sum(F.coalesce("photos", F.lit(0))).cast("long").alias("photos"),
        F.count_if(trimmed(F.col("note")) != "").alias("notes"),
        F.count_if((F.coalesce("arrive", F.lit("")) != "") | (F.coalesce("depart", F.lit("")) != "")).alias("dates"),
        F.count(F.lit(1)).alias("stops"),
    )
    people = trips.select("trip", F.size(F.coalesce("companions", F.array().cast("array<string>"))).cast("long").alias("people"))
    zero, public = F.lit(0).cast("long"), tier == "public"
    full = people.join(counted, "trip", "left").select("trip", "people", *[F.coalesce(c, zero).alias(c) for c in ("photos", "notes", "dates", "stops")])
    items = [
        ("Photographs", F.col("photos")),
        ("Journal notes", zero if public else F.col("notes")),
        ("Travel dates", F.col("dates")),
        ("Companions", F.col("people")),
        ("Approximate locations" if public else "Coordinates", F.col("stops")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label"), n.alias("count")) for i, (label, n) in enumerate(items)])
    return full.select("trip", F.explode(rows).alias("x")).select("trip", "x.*").filter(F.col("count") > 0)


def intros(trips: DataFrame) -> DataFrame:
    """Trimmed intro fields of trips (trip, title, dateline, body), and whether there are any."""
    fields = [intro_text(F.col(c)).alias(c) for c in ("title", "dateline", "body")]
    return trips.select("trip", *fields).withColumn("has_intro", F.concat("title", "dateline", "body") != "")


def first_source(rows: DataFrame, key: list[str], priority: str) -> DataFrame:
    """Of rows from several sources the one of least priority for each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(priority))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """A keyed table with changed rows replaced and new ones added."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def to_load(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are wanted and not cached."""
    return wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(cached.select(key), key, "left_anti")


def copy_legacy(table: DataFrame, legacy: DataFrame, key: list[str]) -> DataFrame:
    """A keyed table with the rows of an older store copied in: a copied row replaces one that is there."""
    return upsert(table, legacy.dropDuplicates(key), key)


def hydrated(wanted: DataFrame, store: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows of the store for the distinct wanted keys that are not cached; keys that it lacks give none."""
    return to_load(wanted, cached, key).join(store, key)


def held(asked: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """asked with ``held``: whether the store has each key."""
    return asked.join(store.select(key).distinct().withColumn("held", F.lit(True)), key, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def without(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The store after keys are deleted."""
    return store.join(gone.select(key), key, "left_anti")


def stale(cached: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Cached rows whose key is not kept: those that a purge takes away."""
    return cached.join(keep.select(key), key, "left_anti")


# Paths that belong to the add-on store.
ADDON = r"/(geo-refined|era-places-full|city-dict-full)\b|/data/regions/|(?i:\.mp3$)|/data/sample-trips/[^/]+/[^/]+\.json$"


def is_addon(url: Column) -> Column:
    """Whether a url's path is one that the add-on store holds."""
    path = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path.rlike(ADDON), F.lit(False))
