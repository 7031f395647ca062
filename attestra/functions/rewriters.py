"""The extension surface: named URL rewriters as column functions, and rule tables from configuration.

A rewriter is any callable Column -> Column. Registering one makes it available by name without loading files at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import urls

REWRITERS: dict[str, Callable[[Column], Column]] = {"arxiv": urls.preprint_html, "github": urls.repository_readme, "preview": urls.without_preview}


def register(name: str, rewriter: Callable[[Column], Column]) -> None:
    REWRITERS[name] = rewriter


def loaded(files: DataFrame) -> dict[str, Callable[[Column], Column]]:
    """files(path, raw), as sources.documents.read_whole reads a folder of configuration: <name>.json with {rules: [{match,
    replace}]} -> rewriters by name. A file that is no such JSON gives none. Rules are data: no code is loaded."""
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), F.from_json("raw", "rules array<struct<match:string,replace:string>>")["rules"].alias("rules"))
    made = {r["name"]: [(x["match"], x["replace"]) for x in r["rules"]] for r in rows.where("name <> '' AND rules IS NOT NULL").collect()}  # configuration
    return {name: (lambda c, own=rules: urls.rewritten(c, own)) for name, rules in made.items()}


def rewrite(name: str, url: Column) -> Column:
    """The named rewriter's result; an unknown name leaves the URL as it is."""
    return REWRITERS.get(name, lambda c: c)(url)


def routed(url: Column, strategies: list[tuple[str, str]], rules: list[tuple[str, str]] = ()) -> Column:
    """The first strategy (host pattern, name) whose pattern is in the host rewrites the URL, else the first rule that matches."""
    out = urls.rewritten(url, list(rules))
    for pattern, name in reversed(strategies):
        out = F.when(urls.host(url).rlike(pattern), rewrite(name, url)).otherwise(out)
    return out

