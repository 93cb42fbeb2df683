"""The thresholds of the rules, their checks and their digest."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.sources.files import saved

# The numbers of a profile in their order, by group: whole or not, least and most, and where the rules have it
# (a family, a number, and the units of the one in the other). 0+ is above 0.
PROFILE = {
    "blocking": {"mediumVictims": ("int", 1, None, "blocking", "medium_victims", 1), "highVictims": ("int", 1, None, "blocking", "high_victims", 1), "mediumPersistenceSeconds": ("int", 0, None, "blocking", "medium_persistence", 1), "highPersistenceSeconds": ("int", 0, None, "blocking", "high_persistence", 1), "transientVictimWaitMs": ("int", 0, None, "blocking", "actionable_ms", 1)},
    "resources": {
        "minimumDurationSeconds": ("int", 0, None, "resources", "minimum_duration", 1), "lowDurationSeconds": ("int", 0, None, "resources", "low_duration", 1), "mediumDurationSeconds": ("int", 0, None, "resources", "medium_duration", 1), "highDurationSeconds": ("int", 0, None, "resources", "high_duration", 1),
        "mediumPercentile": ("number", "0+", 1, "resources", "medium_percentile", 1), "highPercentile": ("number", "0+", 1, "resources", "high_percentile", 1), "lowRepeatedCaptures": ("int", 2, None, "resources", "low_captures", 1), "mediumConfidenceCaptures": ("int", 2, None, "resources", "medium_confidence_captures", 1),
    },
    "waits": {"actionableDurationMs": ("int", 0, None, "waits", "actionable_ms", 1), "highPersistenceSeconds": ("int", 0, None, "waits", "high_persistence", 1), "corroboratingCaptures": ("int", 2, None, "waits", "corroborating_captures", 1), "mediumConfidenceObservations": ("int", 2, None, "waits", "medium_confidence_rows", 1)},
    "workerExhaustion": {"highCaptures": ("int", 2, None, "workers", "high_captures", 1), "highConcurrency": ("int", 2, None, "workers", "high_concurrency", 1), "highConfidenceCaptures": ("int", 2, None, "workers", "confident_captures", 1)},
    "compilePressure": {"highCaptures": ("int", 2, None, "compiles", "high_captures", 1), "highConcurrency": ("int", 2, None, "compiles", "high_concurrency", 1), "highConfidenceCaptures": ("int", 2, None, "compiles", "confident_captures", 1), "highConfidenceVariants": ("int", 2, None, "compiles", "confident_variants", 1)},
    "transactions": {"mediumAgeSeconds": ("int", 0, None, "transactions", "medium_age", 1), "highAgeSeconds": ("int", 0, None, "transactions", "high_age", 1)},
    "plans": {
        "mediumEstimateRatio": ("number", 1, None, "plans", "medium_ratio", 1), "highEstimateRatio": ("number", 1, None, "plans", "high_ratio", 1), "mediumRows": ("int", 1, None, "plans", "medium_rows", 1), "highRows": ("int", 1, None, "plans", "high_rows", 1), "mediumMissingIndexImpact": ("number", 0, 100, "plans", "medium_index_impact", 1),
        "mediumGrantWasteKb": ("int", 0, None, "plans", "medium_waste_mb", 1024), "highGrantWasteKb": ("int", 0, None, "plans", "high_waste_mb", 1024), "mediumGrantRatio": ("number", 1, None, "plans", "medium_waste_ratio", 1), "highGrantRatio": ("number", 1, None, "plans", "high_waste_ratio", 1),
    },
}
# The keys of a kept profile, the forms of its id, version and digest, and the name of the default.
PROFILE_KEYS = ("schemaVersion", "id", "version", "name", "thresholds", "digest")
ID_FORM, VERSION_FORM, DIGEST_FORM = r"^[a-z0-9][a-z0-9._-]{0,63}$", r"^(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)$", r"^[a-f0-9]{64}$"
DEFAULT_NAME = "Published defaults"
_SAFE = 2**53 - 1

# The default thresholds, by rule family.


@dataclass(frozen=True)
class Blocking:
    high_victims: int = 5
    high_persistence: float = 60
    medium_victims: int = 2
    medium_persistence: float = 15
    actionable_ms: float = 1000


@dataclass(frozen=True)
class Resources:
    minimum_duration: float = 30
    low_duration: float = 60
    medium_duration: float = 300
    high_duration: float = 900
    medium_percentile: float = 0.90
    high_percentile: float = 0.95
    low_captures: int = 3
    medium_confidence_captures: int = 2


@dataclass(frozen=True)
class Waits:
    actionable_ms: float = 1000
    high_persistence: float = 60
    corroborating_captures: int = 2
    medium_confidence_rows: int = 2


@dataclass(frozen=True)
class Workers:
    high_captures: int = 2
    high_concurrency: int = 2
    confident_captures: int = 2


@dataclass(frozen=True)
class Compiles:
    high_captures: int = 3
    high_concurrency: int = 4
    confident_captures: int = 2
    confident_variants: int = 2
    ratio: float = 0.1


@dataclass(frozen=True)
class Transactions:
    medium_age: float = 300
    high_age: float = 900


@dataclass(frozen=True)
class Plans:
    medium_ratio: float = 10
    high_ratio: float = 100
    medium_rows: float = 10_000
    high_rows: float = 100_000
    medium_index_impact: float = 70
    medium_waste_mb: float = 128
    medium_waste_ratio: float = 4
    high_waste_mb: float = 512
    high_waste_ratio: float = 8


@dataclass(frozen=True)
class Thresholds:
    blocking: Blocking = field(default_factory=Blocking)
    resources: Resources = field(default_factory=Resources)
    waits: Waits = field(default_factory=Waits)
    workers: Workers = field(default_factory=Workers)
    compiles: Compiles = field(default_factory=Compiles)
    transactions: Transactions = field(default_factory=Transactions)
    plans: Plans = field(default_factory=Plans)

    def document(self) -> dict[str, dict[str, float]]:
        """The numbers under the names of a profile, in its order."""
        own = asdict(self)
        plain = lambda x: int(x) if float(x).is_integer() else x
        return {group: {name: plain(own[family][number] * factor) for name, (_, _, _, family, number, factor) in numbers.items()} for group, numbers in PROFILE.items()}

    def canonical(self, id_: str = "builtin.default", version: str = "1.0.0", name: str = DEFAULT_NAME) -> str:
        return json.dumps({"schemaVersion": "1.0", "id": id_, "version": version, "name": name, "thresholds": self.document()}, separators=(",", ":"), ensure_ascii=False)

    def digest(self, **named: str) -> str:
        return hashlib.sha256(self.canonical(**named).encode()).hexdigest()


def _pairs() -> list[tuple[str, str, str]]:
    """(group, lower, higher) of all numbers of which one must not be above the other, by their names."""
    steps, out = ("minimum", "low", "medium", "high"), []
    for group, numbers in PROFILE.items():
        for name in numbers:
            for low, high in zip(steps, steps[1:]):
                if name.startswith(low) and (other := high + name.removeprefix(low)) in numbers:
                    out.append((group, name, other))
    return out


def check_profiles(profiles: DataFrame) -> DataFrame:
    """profiles (body, a kept profile as JSON) with (profile_id, version, faults, valid): what is wrong with each, by path.

    Keys that are missing or unknown, numbers that are text, no whole numbers or out of range, a cutoff above the next one,
    forms of id, version, name and digest, a digest that is not that of the canonical form (keys in their order, no blanks,
    whole numbers without a point), and another profile of the same id and version with other contents."""
    rows = profiles.withColumns({f"_{k}": F.get_json_object("body", f"$.{k}") for k in ("schemaVersion", "id", "version", "name", "digest", "thresholds")})
    entry = r'"(\w+)":("(?:[^"\\]|\\.)*"|[^,}\[{]+)'
    # the raw numbers of all groups by their paths; a text keeps its quotes
    def entries(g: str) -> Column:
        text = F.coalesce(F.get_json_object("_thresholds", f"$.{g}"), F.lit(""))
        parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(entry), 1).alias("k"), F.regexp_extract_all(text, F.lit(entry), 2).alias("x"))
        return F.transform(parts, lambda e: F.struct(F.concat(F.lit(f"{g}."), e["k"]).alias("key"), e["x"].alias("value")))

    raw = F.map_from_entries(F.flatten(F.array(*map(entries, PROFILE))))
    specs = F.array(*(F.struct(F.lit(f"{g}.{n}").alias("path"), F.lit(g).alias("group"), F.lit(kind == "int").alias("whole"), F.lit(0.0 if low == "0+" else float(low)).alias("low"), F.lit(low == "0+").alias("above"), F.lit(float(high) if high is not None else None).cast("double").alias("high")) for g, numbers in PROFILE.items() for n, (kind, low, high, *_) in numbers.items()))
    pairs = F.array(*(F.struct(F.lit(f"{g}.{x}").alias("a"), F.lit(f"{g}.{y}").alias("b")) for g, x, y in _pairs()))
    rows = rows.withColumn("raw", F.when(F.col("_thresholds").startswith("{"), raw).otherwise(F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("numbers", F.transform_values("raw", lambda _, x: F.when(~x.startswith('"'), x.try_cast("double"))))
    rows = saved(rows, "profiles")  # a small table, from here on of plain columns
    value = lambda path: F.element_at("numbers", path)
    told = lambda found, what: F.transform(found, lambda x: F.concat(x, F.lit(what)))
    paths = lambda test: F.transform(F.filter(specs, lambda s: F.coalesce(test(s), F.lit(False))), lambda s: s["path"])
    whole = lambda s: ~s["whole"] | ((value(s["path"]) == F.floor(value(s["path"]))) & (F.abs(value(s["path"])) <= _SAFE))
    beyond = lambda s: F.when(s["above"], value(s["path"]) <= 0).otherwise(value(s["path"]) < s["low"]) | (value(s["path"]) > s["high"])

    def keys(name: str, json_: Column, expected) -> Column:
        have, wanted = F.json_object_keys(json_), F.array(*map(F.lit, expected))
        lacks = F.concat(told(F.transform(F.array_except(wanted, have), lambda k: F.concat(F.lit(f"{name}."), k)), " required"), told(F.transform(F.array_except(have, wanted), lambda k: F.concat(F.lit(f"{name}."), k)), " unknown"))
        return F.when(have.isNull(), F.array(F.lit(f"{name} object"))).otherwise(lacks)

    bad = lambda c, form: ~F.coalesce(c.rlike(form), F.lit(False))
    name = F.col("_name")
    forms = F.array_compact(F.array(
        F.when(F.coalesce(F.col("_schemaVersion") != "1.0", F.lit(True)), "schemaVersion form"), F.when(bad(F.col("_id"), ID_FORM), "id form"), F.when(bad(F.col("_version"), VERSION_FORM), "version form"),
        F.when(F.coalesce((name != F.trim(name)) | ~F.char_length(name).between(1, 80) | name.rlike("[\\x00-\\x1f\\x7f]"), F.lit(True)), "name form"), F.when(bad(F.col("_digest"), DIGEST_FORM), "digest form")))
    lists = [keys("profile", F.col("body"), PROFILE_KEYS), keys("thresholds", F.col("_thresholds"), tuple(PROFILE)), *(keys(f"thresholds.{g}", F.get_json_object("_thresholds", f"$.{g}"), tuple(numbers)) for g, numbers in PROFILE.items())]
    lists += [forms, told(paths(lambda s: F.map_contains_key("raw", s["path"]) & value(s["path"]).isNull()), " number"), told(paths(lambda s: ~whole(s)), " whole"), told(paths(lambda s: whole(s) & F.coalesce(beyond(s), F.lit(False))), " range")]
    lists.append(told(F.transform(F.filter(pairs, lambda p: F.coalesce(value(p["a"]) > value(p["b"]), F.lit(False))), lambda p: p["a"]), " order"))
    number = lambda x: F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    of = lambda g: F.array_join(F.transform(F.filter(specs, lambda s: s["group"] == g), lambda s: F.concat(F.lit('"'), F.split_part(s["path"], F.lit("."), F.lit(2)), F.lit('":'), number(value(s["path"])))), ",")
    groups = F.concat_ws(",", *(F.concat(F.lit(f'"{g}":{{'), of(g), F.lit("}")) for g in PROFILE))
    quoted = lambda k: F.concat(F.lit(f'"{k}":'), F.regexp_extract(F.to_json(F.struct(F.col(f"_{k}").alias("k"))), '^[{]"k":(.*)[}]$', 1), F.lit(","))
    fresh = F.sha2(F.concat(F.lit("{"), *(quoted(k) for k in ("schemaVersion", "id", "version", "name")), F.lit('"thresholds":{'), groups, F.lit("}}")), 256)
    rows = saved(rows.withColumns({"found": F.flatten(F.array(*lists)), "fresh": fresh}), "profiles")
    differs = F.array_compact(F.array(F.when(F.col("_digest") != F.col("fresh"), "digest differs")))
    rows = rows.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(differs))
    clash = rows.where("_id is not null and _version is not null and size(found) = 0").groupBy("_id", "_version").agg((F.count_distinct("fresh") > 1).alias("clash"))
    faults = F.concat("found", F.array_compact(F.array(F.when(F.col("clash"), "conflict"))))
    out = rows.join(clash, ["_id", "_version"], "left")
    return out.select(F.col("_id").alias("profile_id"), F.col("_version").alias("version"), *(c for c in profiles.columns if c not in ("body", "profile_id", "version")), F.array_join(faults, "|").alias("faults"), (F.size(faults) == 0).alias("valid"))
