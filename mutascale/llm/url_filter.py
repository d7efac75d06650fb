"""URL filter: a broadcast trie over reversed host labels and path segments, longest match wins.

Defined results: a null url or one without ``://`` has an empty host and path, so no rule fits it and the default verdict
holds. Repeated rows are judged each. An empty table gives an empty result. Only the named columns are read, so other
columns may have any name. A list of rules beyond the size of a broadcast is a table, and ``judge_by_join`` gives the same
verdicts by equality joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.llm.texts import LOWER, ascii_lower, splittable, stored

#: Host and path of a url for Spark's regular expressions; as ``PARTS``.
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The rule list travels with every task, so its size is checked.
MAX_RULE_BYTES = 64 << 20
PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.DOTALL)


class Rules:
    """Trie of ``(verdict, "host/path prefix")`` rules.

    Host labels are walked from the last to the first, so a node fits its host and all subdomains. Below a host the path is
    walked by segments; the last segment of a rule may be the start of a longer one. The deepest host wins, then the
    longest path; where one rule is listed with both verdicts, block wins.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        if sum(len(rule.encode()) for _, rule in rules) > MAX_RULE_BYTES:
            raise ValueError(f"more than {MAX_RULE_BYTES} bytes of rules; use judge_by_join")
        self.root: dict = {"labels": {}, "paths": None}
        for verdict, rule in sorted(rules):  # allow first: block replaces it
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            step = node["paths"] = node["paths"] or _step()
            *full, last = (slash + path).split("/")
            for segment in full:
                step = step["next"].setdefault(segment, _step())
            step["tails"][last] = (verdict, rule)
            if len(last) not in step["sizes"]:
                step["sizes"] = sorted([*step["sizes"], len(last)], reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The verdict and text of the longest rule that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = _longest(node["paths"], path) or best
        return best


def _step() -> dict:
    return {"next": {}, "tails": {}, "sizes": []}


def _longest(step: dict, path: str) -> tuple[str, str] | None:
    best = None
    for segment in path.split("/"):
        for size in step["sizes"]:  # the lengths of the last segments here, longest first: far fewer than the segments
            if size <= len(segment) and segment[:size] in step["tails"]:
                best = step["tails"][segment[:size]]
                break
        step = step["next"].get(segment)
        if step is None:
            break
    return best


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row; ``default`` is the verdict where no rule fits."""
    trie = pages.sparkSession.sparkContext.broadcast(Rules(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = trie.value
        for batch in urls:
            rows = []
            for url in batch:
                parts = PARTS.match(url) if isinstance(url, str) else None
                host, path = (parts[1].translate(LOWER), parts[2]) if parts else ("", "")
                verdict, rule = table.match(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return pages.select(F.col(id_col), judged(F.col(url_col)).alias("__judged")).select(id_col, "__judged.*")


def judge_by_join(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The result of ``judge_urls`` for a table of rules ``(verdict, rule)`` of any size.

    A row meets the host suffixes that have rules and then, by equality, its path's beginnings of the lengths that occur there.
    So a row costs its labels and a few lengths, however many rules a host has, and a host's rules are never listed together.
    """
    wrong = rules.where(~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False)))
    if not wrong.isEmpty():
        raise ValueError("a rule's verdict is neither allow nor block")
    slash = F.instr("rule", "/")
    known = rules.select(
        ascii_lower(F.when(slash > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))).alias("suffix"),
        F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("head"), "verdict", "rule",
    ).groupBy("suffix", "head").agg(F.max(F.struct("verdict", "rule")).alias("found"))  # block stands after allow
    sizes = splittable(known.groupBy("suffix").agg(F.collect_set(F.length("head")).alias("sizes")))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = stored(pages.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        ascii_lower(F.regexp_extract(url, SPLIT, 1)).alias("host"), F.regexp_extract(url, SPLIT, 2).alias("path"),
    ), "urls")
    labels = F.split("host", "[.]")
    depth = F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth")
    ends = rows.select("row", "path", labels.alias("labels"), depth).select(
        "row", "path", "depth", F.array_join(F.slice("labels", -F.col("depth"), F.col("depth")), ".").alias("suffix")
    )
    length = F.explode("sizes").alias("length")
    heads = ends.join(sizes, "suffix").select("row", "path", "depth", "suffix", length).where(F.col("length") <= F.length("path")).select(
        "row", "depth", "suffix", "length", F.expr("substring(path, 1, length)").alias("head")
    )
    best = heads.join(splittable(known), ["suffix", "head"]).groupBy("row").agg(
        F.max(F.struct("depth", "length", "found")).getField("found").alias("found")
    )
    return rows.join(splittable(best), "row", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )
