"""JSON pointers, canonical JSON and patches on JSON text columns, as Arrow UDFs."""

from __future__ import annotations

import copy
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The roots that a patch may change.
EDITABLE = ("contact", "summary", "sections")


class _MISSING:
    """Marks absence; a class keeps its identity in the workers."""



def parts(pointer: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def resolved(value, pointer: str):
    """What a pointer names in a parsed document, or a marker of absence."""
    for key in parts(pointer):
        if isinstance(value, list) and key.isdigit() and int(key) < len(value):
            value = value[int(key)]
        elif isinstance(value, dict) and key in value:
            value = value[key]
        else:
            return _MISSING
    return value


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def patched(document: dict, operation: str, pointer: str, value) -> dict | None:
    """A changed copy; None where the path is not editable or absent, or where nothing would change."""
    keys = parts(pointer)
    if not keys or keys[0] not in EDITABLE:
        return None
    out = copy.deepcopy(document)
    parent = resolved(out, "".join("/" + k.replace("~", "~0").replace("/", "~1") for k in keys[:-1])) if len(keys) > 1 else out
    last, there = keys[-1], resolved(document, pointer) is not _MISSING
    if isinstance(parent, list):
        at = len(parent) if last == "-" else int(last) if last.isdigit() else -1
        if at < 0 or at > len(parent) or (operation != "add" and not there):
            return None
        if operation == "add":
            parent.insert(at, value)
        elif operation == "replace":
            parent[at] = value
        else:
            del parent[at]
    elif isinstance(parent, dict):
        if operation != "add" and not there:
            return None
        if operation == "remove":
            del parent[last]
        else:
            parent[last] = value
    else:
        return None
    return None if canonical(out) == canonical(document) else out


@F.pandas_udf(StringType())
def get_pointer(document: pd.Series, pointer: pd.Series) -> pd.Series:
    """Canonical JSON of what the pointer names; null where nothing is there or the document is null or no JSON."""
    def one(doc, path):
        try:
            found = resolved(json.loads(doc), path)
        except (TypeError, ValueError):
            return None
        return None if found is _MISSING else canonical(found)

    return pd.Series([one(d, p) for d, p in zip(document, pointer, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def patch(document: pd.Series, operation: pd.Series, pointer: pd.Series, value: pd.Series) -> pd.Series:
    """The patched document as canonical JSON; null where the patch is refused."""
    def one(doc, op, path, new):
        try:
            out = patched(json.loads(doc), op, path, json.loads(new) if new is not None else None)
        except (TypeError, ValueError):
            return None
        return None if out is None else canonical(out)

    return pd.Series([one(*x) for x in zip(document, operation, pointer, value, strict=True)], dtype=object)
