"""The metadata file: session fields, groups and per-stream specs over defaults."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolwave.sources.files import file_system

#: The keys that a file may have; any other is an error.
KEYS = {
    "session": {"description", "experimenter", "institution", "lab", "start_time", "timezone", "keywords", "notes"},
    "subject": {"id", "species", "sex", "age", "description", "genotype", "strain", "weight"},
    "groups": {"name", "description", "location", "device", "impedances"},
    "streams": {"include", "type", "out_name", "description", "unit", "group"},
    "snippets": {"include", "out_name", "description", "group"},
}
SEXES = ("M", "F", "O", "U")
SPEC = "key string, include boolean, type string, out_name string, description string, unit string, `group` string"


def _load(text: str, path: str) -> dict[str, Any]:
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need the yaml module; JSON files do not") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def check(data: dict[str, Any]) -> None:
    """Unknown keys and unknown sexes are errors, with their place."""
    for part, value in data.items():
        if part not in KEYS:
            raise ValueError(f"unknown key {part}")
        rows = value if isinstance(value, list) else list(value.values()) if part in ("streams", "snippets") else [value]
        for row in rows:
            if bad := set(row or {}) - KEYS[part]:
                raise ValueError(f"unknown key {part}.{sorted(bad)[0]}")
    sex = (data.get("subject") or {}).get("sex")
    if sex is not None and sex not in SEXES:
        raise ValueError(f"subject.sex must be one of {', '.join(SEXES)}")


def faults(files: DataFrame, text: str = "text") -> DataFrame:
    """files with `fault`, a row for each key of a file's JSON text that no file may have, and for a sex that is none (S58): the checks
    of `check` for any number of files, on executors. A text that is no JSON object has the fault `no metadata`."""
    keep = [c for c in files.columns if c != text]
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    parts = F.from_json(F.col(text), "map<string, string>")
    rows = files.withColumn("_keys", F.json_object_keys(F.col(text))).withColumn("_parts", parts)
    found = [F.when(F.col("_keys").isNull(), F.array(F.lit("no metadata"))), F.transform(F.array_sort(F.array_except("_keys", F.array(*map(F.lit, sorted(KEYS))))), lambda k: F.concat(F.lit("unknown key "), k))]
    for part, allowed in sorted(KEYS.items()):
        own = F.col("_parts")[part]
        if part in ("streams", "snippets"):
            inner = F.flatten(F.transform(F.map_values(F.from_json(own, "map<string, string>")), keys))
        elif part == "groups":
            inner = F.flatten(F.transform(F.from_json(own, "array<string>"), keys))
        else:
            inner = keys(own)
        found.append(_unknown(part, inner, allowed))
    sex = F.get_json_object(F.col(text), "$.subject.sex")
    found.append(F.when(sex.isNotNull() & ~sex.isin(*SEXES), F.array(F.lit("subject.sex"))))
    none = F.array().cast("array<string>")
    return rows.select(*keep, F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("fault"))


def _unknown(part: str, inner: Column, allowed: set[str]) -> Column:
    extra = F.array_sort(F.array_distinct(F.array_except(inner, F.array(*map(F.lit, sorted(allowed))))))
    return F.transform(extra, lambda k: F.concat(F.lit(f"unknown key {part}."), k))


def subjects(stated: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, field, value): stated over recorded fields of every subject, U for an unknown sex, only what is present; an age counts
    from birth (K21, P25). A subject that only one side has counts with what that side says."""
    names = sorted(KEYS["subject"])
    own = lambda df, side: df.select(F.col(key).alias(f"_{side}"), *[F.nullif(F.col(n).cast("string"), F.lit("")).alias(f"{side}_{n}") for n in names if n in df.columns])
    a, b = own(stated, "a"), own(recorded, "b")
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    value = {n: F.coalesce(*[F.col(f"{side}_{n}") for side, df in (("a", a), ("b", b)) if f"{side}_{n}" in df.columns], F.lit(None).cast("string")) for n in names}
    some = F.coalesce(*[v for v in value.values()]).isNotNull()
    value["sex"] = F.coalesce(value["sex"], F.lit("U"))
    value["age_reference"] = F.when(value["age"].isNotNull(), "birth")
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in sorted(value.items())])).alias("_f")
    return both.where(some).select(F.coalesce("_a", "_b").alias(key), fields).select(key, "_f.field", "_f.value").where("value is not null")


def read(path: str) -> dict[str, Any]:
    fs, where = file_system(path)
    with fs.open_input_stream(where) as f:
        data = _load(f.read().decode("utf-8"), where)
    check(data)
    return data


def prune(value: Any) -> Any:
    """Without nulls, empty texts, lists and maps, at any depth."""
    if isinstance(value, dict):
        out = {k: p for k, v in value.items() if (p := prune(v)) not in (None, "", [], {})}
        return out
    if isinstance(value, list):
        return [p for v in value if (p := prune(v)) not in (None, "", [], {})]
    return value


def write(data: dict[str, Any], path: str) -> None:
    """Only what is set goes out; reading it back gives the same."""
    check(data)
    fs, where = file_system(path)
    with fs.open_output_stream(where) as f:
        f.write(json.dumps(prune(data), indent=2, ensure_ascii=False).encode("utf-8"))


def spec(spark: SparkSession, data: dict[str, Any], part: str = "streams") -> DataFrame:
    """The specs of a part as rows, "*" for the default, for with_spec and resolve."""
    rows = [(k, v.get("include"), v.get("type"), v.get("out_name"), v.get("description"), v.get("unit"), v.get("group")) for k, v in (data.get(part) or {}).items()]
    return spark.createDataFrame(rows, SPEC)


def subject(data: dict[str, Any], recorded: dict[str, str] | None = None) -> dict[str, str]:
    """Stated over recorded fields, U for an unknown sex, only what is present; an age counts from birth."""
    merged = prune({**(recorded or {}), **prune(data.get("subject") or {})})
    if not merged:
        return {}
    merged.setdefault("sex", "U")
    if "age" in merged:
        merged["age_reference"] = "birth"
    return merged
