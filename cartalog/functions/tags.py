"""Which tags matter for what: predicates and small mappings over (key, value), as native expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tag model: lists and maps in which results depend on the very entries.
FULL_TEXT_KEYS = ("leisure", "railway", "tourism", "public_transport", "shop")
NO_FULL_TEXT_KEYS = ("email", "fax", "phone", "website", "wikipedia", "opening_hours", "addr:housenumber")
USER_KEYS = (
    "email", "fax", "phone", "website", "wikipedia", "opening_hours", "operator", "name", "ref", "postal_code", "alt_name",
    "int_name", "loc_name", "nat_name", "official_name", "old_name", "reg_name", "short_name",
)
ADDRESS_KEYS = (
    "addr:housenumber", "addr:housename", "addr:street", "addr:place", "addr:postcode", "addr:city", "addr:country", "addr:suburb",
    "addr:subdistrict", "addr:district", "addr:hamlet", "addr:province", "addr:state", "addr:full",
)
DECODABLE_KEYS = ("addr:country", "addr:state", "addr:city", "addr:suburb", "addr:district", "addr:postcode", "addr:zip", "addr:street", "addr:housenumber")
SPLIT_KEYS = ("name", "alt_name", "int_name", "loc_name", "nat_name", "official_name", "old_name", "reg_name", "short_name", "operator")
NO_SPLIT_KEYS = ("opening_hours", "phone", "fax")
META_VALUES = ("yes", "no", "limited", "true", "false", "maybe", "1", "0", "german")
NOT_WRITABLE = {"building": ("yes",), "shop": ("yes",), "office": ("yes",), "amenity": ("public_building",), "ref": ("*",)}
ALONE_DEPRECATED = {"amenity": ("parking",), "highway": ("*",), "ref": ("*",)}
AGGREGATE_KEYS = ("amenity", "building", "leisure", "place", "public_transport", "shop", "sport", "tourism", "office", "highway", "emergency")
CANONICAL = {
    ("highway", "bus_stop"): ("public_transport", "bus_stop"),
    ("amenity", "bus_station"): ("public_transport", "bus_stop"),
    ("public_transport", "halt"): ("public_transport", "stop"),
    ("public_transport", "subway_entrance"): ("public_transport", "subway"),
    ("public_transport", "railway"): ("public_transport", "train"),
    ("public_transport", "platform"): ("public_transport", "station"),
    ("public_transport", "stop_position"): ("public_transport", "stop"),
    ("railway", "tram"): ("public_transport", "tram"),
    ("railway", "tram_stop"): ("public_transport", "tram"),
    ("railway", "platform"): ("railway", "station"),
    ("railway", "halt"): ("railway", "stop"),
    ("amenity", "nightclub"): ("amenity", "club"),
    ("postal_code", "*"): ("addr:postcode", "*"),
}
#: Levels of address areas; within one, later ones weigh more.
AREA_LEVELS = (
    ("country",),
    ("province", "region", "county", "state"),
    ("island", "archipelago", "village", "town", "city"),
    ("neighbourhood", "locality", "hamlet", "district", "suburb"),
    ("street", "postcode"),
)
NO_TURNS = ("no_right_turn", "no_left_turn", "no_straight_on", "no_entry", "no_exit", "no_u_turn")
ONLY_TURNS = ("only_right_turn", "only_left_turn", "only_straight_on")
ROADS = {
    "motorway": 140, "motorway_link": 80, "trunk": 100, "trunk_link": 80, "primary": 120, "primary_link": 100, "secondary": 90,
    "secondary_link": 60, "tertiary": 80, "tertiary_link": 60, "residential": 60, "unclassified": 20, "living_street": 20, "road": 80,
}
ACCESS_KEYS = ("access", "vehicle", "motor_vehicle", "motorcar")
ACCESS_VALUES = ("yes", "designated", "permissive", "unknown", "destination", "customer", "official")
FORBIDDEN = {"construction": ("yes",), "access": ("no",), "vehicle": ("no",), "motorcar": ("no",), "motorcycle": ("no",), "highway": ("area", "construction")}
ONE_WAY, NOT_ONE_WAY, REVERSED = ("true", "1", "yes", "-1", "reverse"), ("false", "0", "no"), ("-1", "reverse")
ONE_WAY_ROADS = ("motorway", "motorway_link", "trunk", "roundabout")
FOOTWAYS = ("trunk", "pedestrian", "living_street", "footway", "steps", "track", "path", "primary", "secondary", "tertiary", "unclassified", "residential", "road", "service")
WALKING_SPEED = 10
STYLE_GROUPS = {
    "trunk": "motorway", "motorway": "motorway", "primary": "mainroad", "secondary": "mainroad", "motorway_link": "minorroad", "trunk_link": "minorroad", "primary_link": "minorroad",
    "secondary_link": "minorroad", "tertiary": "minorroad", "tertiary_link": "minorroad", "residential": "minorroad", "unclassified": "minorroad", "road": " minorroad",
    "living_street": "minorroad", "service": "service", "track": "service", "path": "noauto", "cycleway": "noauto", "footway": "noauto", "pedestrian": "noauto", "steps": "noauto",
    "bridleway": "noauto", "light_rail": "railway", "subway": "railway", "narrow_gauge": "railway", "rail": "railway", "tram": "railway",
}
#: Kilometres an hour in metres a second.
KMH = 0.277778


def one_of(column: Column, values: Iterable[str]) -> Column:
    return column.isin(*values)


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_full_text(key: Column) -> Column:
    return one_of(key, FULL_TEXT_KEYS)


def is_full_text_pair(key: Column) -> Column:
    return ~one_of(key, NO_FULL_TEXT_KEYS)


def valid_value(value: Column) -> Column:
    return ~value.contains("|")


def is_name(key: Column) -> Column:
    return key.startswith("name")


def is_address(key: Column) -> Column:
    return one_of(key, ADDRESS_KEYS)


def is_unique(key: Column) -> Column:
    return is_address(key)


def is_address_decodable(key: Column) -> Column:
    return one_of(key, DECODABLE_KEYS)


def is_address_area(key: Column) -> Column:
    return one_of(key, [f"addr:{a}" for level in AREA_LEVELS for a in level])


def area_prefix(key: Column) -> Column:
    """The area named by a decodable address key, else ''."""
    return F.when(is_address_decodable(key), F.substr(key, F.lit(6))).otherwise("")


def area_level(area: Column) -> Column:
    """0 for a country to 4 for streets and postcodes; -1 for what is no area."""
    out = F.lit(-1)
    for level, areas in enumerate(AREA_LEVELS):
        out = F.when(one_of(area, areas), level).otherwise(out)
    return out


def parent_areas(area: Column) -> Column:
    """The kinds of area above, nearest level first, heaviest of a level first."""
    out = F.array().cast("array<string>")
    for level, areas in enumerate(AREA_LEVELS):
        above = [a for upper in AREA_LEVELS[:level] for a in upper][::-1]
        out = F.when(one_of(area, areas), F.array(*map(F.lit, above)).cast("array<string>")).otherwise(out)
    return out


def is_aggregate(key: Column) -> Column:
    return one_of(key, AGGREGATE_KEYS)


def user_entered(key: Column) -> Column:
    return is_name(key) | one_of(key, USER_KEYS) | is_address(key)


def valid_user_pair(key: Column, value: Column) -> Column:
    """Postcodes: letters, digits, blanks and dashes with two letters at most; phone and fax: digits and their marks."""
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    postcode = value.rlike("^[A-Za-z0-9 -]*$") & (letters <= 2)
    return F.when(key == "addr:postcode", postcode).when(key.isin("phone", "fax"), value.rlike("^[0-9()+ -]*$")).otherwise(True)


def is_meta_free(value: Column) -> Column:
    """Whether the value says more than yes or no."""
    return ~one_of(value, META_VALUES)


def valid_fixed_value(value: Column) -> Column:
    return value.rlike("^[a-z;_]*$")


def split_fixed(value: Column) -> Column:
    return F.transform(F.split(value, ";"), lambda x: F.trim(x))


def _listed(key: Column, value: Column, table: Mapping[str, Iterable[str]]) -> Column:
    return _any((key == k) & (F.lit(True) if "*" in values else one_of(value, values)) for k, values in table.items())


def allow_fixed(key: Column, value: Column, config: Mapping[str, Iterable[str]]) -> Column:
    """Whether a pair is one of the config's: a value, or * for any but those with a minus before them."""
    rules = []
    for k, values in config.items():
        values = list(values)
        ruled_out = [v[1:] for v in values if v.startswith("-")]
        named = [v for v in values if not v.startswith("-") and v != "*"]
        ok = (valid_fixed_value(value) if "*" in values else F.lit(False)) | one_of(value, named or [""])
        rules.append((key == k) & ok & ~one_of(value, ruled_out or [""]))
    return _any(rules)


def writable(key: Column, value: Column) -> Column:
    return ~_listed(key, value, NOT_WRITABLE)


def alone_deprecated(key: Column, value: Column) -> Column:
    return _listed(key, value, ALONE_DEPRECATED)


def accept_tag(key: Column, value: Column, config: Mapping[str, Iterable[str]]) -> Column:
    return (allow_fixed(key, value, config) & writable(key, value)) | user_entered(key)


def accept_object(tags: Column, config: Mapping[str, Iterable[str]]) -> Column:
    """Whether an array of structs (key, value) has a tag that is worth storing."""
    return F.exists(tags, lambda t: (writable(t["key"], t["value"]) & allow_fixed(t["key"], t["value"], config) & ~alone_deprecated(t["key"], t["value"])) | one_of(t["key"], USER_KEYS))


def is_splittable(key: Column) -> Column:
    return ~one_of(key, NO_SPLIT_KEYS) | one_of(key, SPLIT_KEYS + ADDRESS_KEYS) | user_entered(key)


def country_codes(path: str = "/usr/share/zoneinfo/iso3166.tab") -> tuple[str, ...]:
    """The two-letter codes of ISO 3166, from the table that comes with the time zones; the path is a parameter."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return tuple(line.split("\t")[0] for line in lines if line and not line.startswith("#"))


def is_country_code(code: Column, codes: Iterable[str]) -> Column:
    """In capitals or small letters, not mixed."""
    codes = tuple(codes)
    return one_of(code, codes + tuple(c.lower() for c in codes))


def canonical(key: Column, value: Column) -> Column:
    """The pair (key, value) that a pair is another way of writing; itself if it is none."""
    new_key, new_value = key, value
    for (k, v), (to_key, to_value) in CANONICAL.items():
        hit = (key == k) if v == "*" else (key == k) & (value == v)
        new_key = F.when(hit, to_key).otherwise(new_key)
        new_value = F.when(hit, value if to_value == "*" else F.lit(to_value)).otherwise(new_value)
    return F.struct(new_key.alias("key"), new_value.alias("value"))


def rank_object(tags: Column, config: Mapping[str, Iterable[str]]) -> Column:
    """How much an object's tags say about it: one a tag, and more for writable ones that are accepted, entered by users, of an address or a name."""

    def worth(t: Column) -> Column:
        k, v = t["key"], t["value"]
        extra = accept_tag(k, v, config).cast("int") + 2 * user_entered(k).cast("int") + 2 * is_address(k).cast("int") + 30 * is_name(k).cast("int")
        return F.lit(1) + F.when(writable(k, v), extra).otherwise(0)

    return F.aggregate(tags, F.lit(0), lambda s, t: s + worth(t))


def is_road(value_of: Mapping[str, Column]) -> Column:
    """Whether a way is a road for cars, by its tags' columns: a required tag, access tags with a right value if there, none that forbids it.

    value_of: a column per key of highway, construction, motorcycle and ACCESS_KEYS that the data has; keys left out count as not there.
    """
    required = F.coalesce(one_of(value_of["highway"], ROADS), F.lit(False))
    allowed = [F.coalesce(one_of(value_of[k], ACCESS_VALUES), F.lit(True)) for k in ACCESS_KEYS if k in value_of]
    barred = [F.coalesce(one_of(value_of[k], values), F.lit(False)) for k, values in FORBIDDEN.items() if k in value_of]
    return reduce(lambda a, b: a & b, allowed, required) & ~_any(barred)


def is_footway(highway: Column) -> Column:
    return F.coalesce(one_of(highway, FOOTWAYS), F.lit(False))


def kmh(highway: Column) -> Column:
    out = F.lit(None).cast("int")
    for road, limit in ROADS.items():
        out = F.when(highway == road, limit).otherwise(out)
    return out


def speed(highway: Column) -> Column:
    """Whole metres a second that a kind of road allows; null for what is none."""
    return F.floor(kmh(highway) * KMH).cast("int")


def one_way(oneway: Column, highway: Column, junction: Column | None = None) -> Column:
    """The way's own word, then what its kind of road or junction implies."""
    implied = F.coalesce(one_of(highway, ONE_WAY_ROADS), F.lit(False))
    if junction is not None:
        implied = implied | F.coalesce(one_of(junction, ONE_WAY_ROADS), F.lit(False))
    return F.when(one_of(oneway, ONE_WAY), True).when(one_of(oneway, NOT_ONE_WAY), False).otherwise(implied)


def is_reversed(oneway: Column) -> Column:
    return F.coalesce(one_of(oneway, REVERSED), F.lit(False))


def is_no_turn(kind: Column) -> Column:
    return one_of(kind, NO_TURNS)


def is_only_turn(kind: Column) -> Column:
    return one_of(kind, ONLY_TURNS)


def style_group(value: Column) -> Column:
    """The group that a road or rail is drawn in; other for all else."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STYLE_GROUPS.items() for x in pair])[value], F.lit("other"))


def layer_wanted(tags: Column, wanted: Mapping[str, Iterable[str]]) -> Column:
    """Whether a map of tags has all of a layer's keys with one of its values, or any value for *."""
    return reduce(lambda a, b: a & b, [F.coalesce(tags[k].isNotNull() if "*" in values else one_of(tags[k], values), F.lit(False)) for k, values in wanted.items()], F.lit(True))


def pick_layer(tags: Column, layers: Mapping[str, Mapping[str, Iterable[str]]]) -> Column:
    """The first layer, in the order given, that wants an object; null if none does."""
    return F.coalesce(*[F.when(layer_wanted(tags, wanted), F.lit(name)) for name, wanted in layers.items()], F.lit(None).cast("string"))
