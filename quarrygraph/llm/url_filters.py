"""URL rules behind an index of their rarest literal tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm._frames import to_batch
from quarrygraph.sources.tables import table

TOKENS = re.compile(r"[a-z0-9]+")
HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rules travel with the tasks; more than this is refused rather than shipped.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path; ``literals`` are tokens that every match holds whole.

    Where several rules fit, the largest ``rank`` wins, then the earlier rule.
    """

    name: str | None
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for ``host`` and its subdomains whose url path starts with ``path`` (which starts with /)."""
    whole = host.lower()
    # A token that the path's end may cut is no literal: /en/1 also fits /en/12.
    inner = path if not path or not path[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path)
    literals = tuple(dict.fromkeys(TOKENS.findall(whole) + TOKENS.findall(inner.translate(UPPER))))
    return Rule(host + path, verdict, rf"(?:[^/?#]*\.)?{re.escape(whole)}{re.escape(path)}", literals, 1000 + len(host) + len(path))


def pattern_rule(verdict: str, pattern: str, *literals: str) -> Rule:
    """A general pattern, searched from the start of host + path; it names no rule in the result."""
    return Rule(None, verdict, pattern, literals, 0)


RULES = (
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
)
#: The method's own patterns, for urls that no host rule fits.
PATTERNS = (
    pattern_rule("block", r"(?:[^/]*\.)?spam-farm\.", "spam", "farm"),
    pattern_rule("block", r"(?:[^/]*\.)?(?:ads?|adserver|doubleclick)\.[^/]*/.*banner"),  # banner may be part of a token, so no literal
    pattern_rule("block", r"[^/]*/(?:.*/)?casino(?:/|$)", "casino"),
    pattern_rule("block", r"[^/]*/(?:.*/)?wp-login\.php$", "wp", "login", "php"),
)


def split_url(url: str | None) -> tuple[str, str]:
    found = HOST.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def index_rules(rules: Sequence[Rule], frequency: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest literal (ties: the longer, then by name), and those without any."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.literals:
            index.setdefault(min(rule.literals, key=lambda t: (frequency.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def token_frequency(df: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens occurs, over the whole table (at most one row a token)."""
    if not tokens:
        return {}
    found = F.expr(rf"array_distinct(regexp_extract_all(lower(`{url}`), '[a-z0-9]+', 0))")
    wanted = F.array(*map(F.lit, tokens)) if len(tokens) <= 2000 else None
    tokens_of = F.array_intersect(found, wanted) if wanted is not None else found
    counts = df.select(F.explode(tokens_of).alias("token")).groupBy("token").count()
    if wanted is None:
        counts = counts.join(df.sparkSession.createDataFrame([(t,) for t in tokens], "token string"), "token", "left_semi")
    return {r["token"]: r["count"] for r in counts.collect()}


VERDICTS = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_candidates", pa.int32())])


def filter_urls(df: DataFrame, rules: Sequence[Rule] = RULES + PATTERNS, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judge every url: its tokens fetch the candidate rules, and only those run their expressions.

    One narrow pass without a shuffle; the token counts that choose each rule's key are over the
    whole table.  Null urls and urls without ``://`` have empty host and path and get ``default``
    (no rule can fit them); equal urls get equal rows, an empty table gives no rows.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are shipped with the tasks")
    index, always = index_rules(rules, token_frequency(df, url, sorted({t for r in rules for t in r.literals})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in VERDICTS}
            for page, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(value)
                whole = host + path
                tokens = set(TOKENS.findall(whole.translate(UPPER))) if whole else ()
                candidates = [i for t in tokens if t in index for i in index[t]] + (always if whole else [])
                best = None
                for i in candidates:
                    pattern = compiled.get(i) or compiled.setdefault(i, re.compile(rules[i].pattern, re.S))
                    if pattern.match(whole) and (best is None or (rules[i].rank, -i) > (rules[best].rank, -best)):
                        best = i
                row = (page, host, path, None if best is None else rules[best].name, default if best is None else rules[best].verdict, len(candidates))
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield to_batch(out, VERDICTS)

    return df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_candidates int")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("n_candidates")
