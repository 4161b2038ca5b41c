"""Functions on JSON of unknown shape; recursion has no column expression, so these are pandas UDFs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What names of secrets contain, what stands for them, and what is shown of texts and lists.
_SECRET = ("token", "secret", "password", "api_key", "authorization")
_MASK = "***REDACTED***"
_TEXT, _LIST = 500, 50


def _clean(value: object) -> object:
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return value[:_TEXT]
    if isinstance(value, dict):
        return {k: _MASK if any(s in k.lower() for s in _SECRET) else _clean(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v) for v in value[:_LIST]]
    return value


def sanitised(text: str | None) -> str | None:
    """A stored text as it may be shown.

    JSON, also inside strings of it, without secrets and with lists of fifty at most; any other
    text cut to 500 characters. JSON that is nested too deeply to be read is such a text.
    """
    if text is None:
        return None
    try:
        clean = _clean(text)
    except RecursionError:
        return text[:_TEXT]
    return clean if isinstance(clean, str) else json.dumps(clean, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(T.StringType())
def sanitise(texts: pd.Series) -> pd.Series:
    """Column version of sanitised()."""
    return texts.map(sanitised)


def _walk(value: object) -> list[tuple[str, str]]:
    found, todo = [], [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            todo += node.values()
            if isinstance(node.get("email"), str):
                found.append(("email", node["email"]))
            same = node.get("sameAs")
            for link in [same] if isinstance(same, str) else same if isinstance(same, list) else []:
                if isinstance(link, str):
                    found += [("telegram", link)] * ("t.me" in link or "telegram" in link) + [("linkedin", link)] * ("linkedin.com" in link)
    return found


def linked_data_contacts(scripts: list[str]) -> list[dict[str, str]]:
    """Contacts in linked-data scripts as written there, sorted, each once; scripts that aren't JSON have none."""
    found: set[tuple[str, str]] = set()
    for script in scripts if scripts is not None else ():
        try:
            found.update(_walk(json.loads(script.strip())))
        except (ValueError, RecursionError):
            continue
    return [{"contact_type": kind, "value": value} for kind, value in sorted(found)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("contact_type", T.StringType()), T.StructField("value", T.StringType())])))
def linked_data(scripts: pd.Series) -> pd.Series:
    """Column version of linked_data_contacts(); null scripts, of pages without one, have none."""
    return scripts.map(linked_data_contacts)


LINKED_DATA = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
