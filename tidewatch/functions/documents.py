"""Host-scan documents: last-wins fold of nested JSON and the feature projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def overlay(base: Column, top: Column) -> Column:
    """Keys of both maps; a key of ``top`` wins, even with a null value."""
    return F.map_zip_with(
        base,
        top,
        lambda key, low, high: F.when(F.map_contains_key(top, key), high).otherwise(low),
    )


def fold_items(items: Column) -> Column:
    """Left-to-right shallow merge of an array of maps."""
    empty = F.from_json(F.lit("{}"), _MAP)
    filled = F.coalesce(items, F.array().cast(f"array<{_MAP}>"))
    return F.aggregate(filled, empty, lambda acc, item: F.coalesce(overlay(acc, item), acc))


def merged_document(top: Column) -> Column:
    """``data[]`` items folded in order, then the top-level keys, of a parsed document."""
    items = F.from_json(F.element_at(top, "data"), f"array<{_MAP}>")
    return overlay(fold_items(items), top)


def parsed(json: Column) -> Column:
    """A document's top-level keys with their values as JSON text; null for malformed JSON."""
    return F.from_json(json, _MAP)


def flatten(name: str) -> Column:
    """A JSON list column to its items joined by ``", "``; objects and plain values stay."""
    return F.expr(
        f"CASE WHEN startswith({name}, '[') "
        f"THEN coalesce(array_join(from_json({name}, 'array<string>'), ', '), {name}) ELSE {name} END"
    )


def key_names(name: str) -> Column:
    """The keys of a JSON object column joined by ``", "``."""
    return F.expr(f"array_join(json_object_keys({name}), ', ')")


# Top-level features, and the nested ones with their place (fixed values).
PLAIN = "product version cpe cpe23 hostnames domains tags asn org isp".split()
NESTED = {
    "components": "http.components",
    "server": "http.server",
    "ssh_key": "ssh.key",
    "ssh_kex": "ssh.kex.kex_algorithms",
    "ssh_mac": "ssh.kex.mac_algorithms",
    "ssh_cipher": "ssh.cipher",
    "ssl_ja3s": "ssl.ja3s",
    "ssl_jarm": "ssl.jarm",
    "ssl_fingerprint": "ssl.cert.fingerprint.sha256",
    "ssl_issuer": "ssl.cert.issuer",
    "ssl_subject": "ssl.cert.subject",
}
LOCATED = ("country_code", "region_code")

# Schemas of the nested objects; a text field keeps an object's or list's JSON (fixed values).
OBJECTS = {
    "http": "server string, components string",
    "ssh": "key string, kex struct<kex_algorithms:string,mac_algorithms:string>, cipher string",
    "ssl": "ja3s string, jarm string, "
    "cert struct<fingerprint:struct<sha256:string>,issuer:string,subject:string>",
    "location": "country_code string, region_code string",
}


def opened(doc: Column) -> dict[str, Column]:
    """First step of the feature projection: top-level texts, and each nested object parsed once."""

    def field(key: str) -> Column:
        return F.try_element_at(doc, F.lit(key))

    found = {name: field(name) for name in (*PLAIN, "vulns", *LOCATED)}
    return found | {name: F.from_json(field(name), ddl) for name, ddl in OBJECTS.items()}


def raw_features() -> dict[str, Column]:
    """Second step: each feature's own text."""
    found = {name: F.col(name) for name in (*PLAIN, "vulns", *LOCATED)}
    found |= {name: F.col(path) for name, path in NESTED.items()}
    return found | {f"_{name}": F.col(f"location.{name}") for name in LOCATED}


def shaped_features(names: list[str]) -> dict[str, Column]:
    """Third step: lists flattened, object keys named, and place fields filled up."""
    shaped = {name: flatten(name) for name in (*PLAIN, *NESTED, "vulns")}
    shaped["components"] = key_names("components")
    # An object of vulnerabilities counts by its keys, so that the CVE names survive.
    is_object = F.col("vulns").startswith("{")
    shaped["vulns"] = F.when(is_object, key_names("vulns")).otherwise(shaped["vulns"])
    for name in LOCATED:
        shaped[name] = F.expr(f"coalesce(nullif({name}, ''), _{name})")
    return {name: shaped[name] for name in names}


def final_features(names: list[str]) -> dict[str, Column]:
    """Fourth step: empty values to null; a nested zero or false counts as empty too."""
    empty = {name: "'', '{}', '[]'" + (", '0', 'false'" if name in NESTED else "") for name in names}
    return {name: F.expr(f"CASE WHEN {name} NOT IN ({empty[name]}) THEN {name} END") for name in names}
