"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm.decontaminate import op8_decontamination
from quarrygraph.llm.language_id import op6_language_id
from quarrygraph.llm.media import op4_media
from quarrygraph.llm.packing import op3_packing
from quarrygraph.llm.sharding import op10_sharding
from quarrygraph.llm.simhash import op7_simhash
from quarrygraph.llm.suffix_dedup import op1_suffix_dedup
from quarrygraph.llm.token_output import op9_token_output
from quarrygraph.llm.toxicity import op2_toxicity
from quarrygraph.llm.url_filters import op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_url_filters": op5_url_filters,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_token_output": op9_token_output,
    "op10_sharding": op10_sharding,
}
_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


#: The other eight rest on models, exchanged digests or heuristics that SQL over whole tables cannot state; tests hold
#: them against brute force, an exact round trip or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op5_url_filters": (
        f"WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path FROM pages), "
        f"r AS (SELECT *, CASE WHEN {_fits('example.org', '/en/1')} THEN 'example.org/en/1' WHEN {_fits('example.org', '/es/')} THEN 'example.org/es/' WHEN {_fits('com', '/fr/')} THEN 'com/fr/' WHEN {_fits('com', '/de/')} THEN 'com/de/' WHEN {_fits('org', '/')} THEN 'org/' END rule FROM u) "
        r"SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR regexp_matches(host || path, '(?s)^(?:[^/]*\.)?spam-farm\.') OR regexp_matches(host || path, '(?s)^(?:[^/]*\.)?(?:ads?|adserver|doubleclick)\.[^/]*/.*banner') "
        r"OR regexp_matches(host || path, '(?s)^[^/]*/(?:.*/)?casino(?:/|$)') OR regexp_matches(host || path, '(?s)^[^/]*/(?:.*/)?wp-login\.php$') THEN 'block' ELSE 'allow' END AS verdict FROM r"
    ),
    "op8_decontamination": (
        f"WITH dk AS (SELECT doc_id, {_TOKENS} k FROM documents), ik AS (SELECT item_id, {_TOKENS} k FROM benchmark), d AS (SELECT doc_id, unnest(k) t, generate_subscripts(k, 1) - 1 p FROM dk), i AS (SELECT item_id, least(20, len(k)) run, unnest(k) t, generate_subscripts(k, 1) - 1 p FROM ik), "
        "m AS (SELECT doc_id, item_id, run, d.p - i.p shift, i.p p FROM d JOIN i USING (t)), s AS (SELECT doc_id, item_id, shift FROM m GROUP BY ALL HAVING count(*) >= 0.8 * any_value(run)), "
        "c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) c FROM m JOIN s USING (doc_id, item_id, shift)) "
        "SELECT doc_id, item_id, CAST(shift + p AS INTEGER) AS doc_start, CAST(p AS INTEGER) AS item_start, CAST(run AS INTEGER) AS n_tokens, CAST(c AS INTEGER) AS n_matched FROM c WHERE c >= 0.8 * run QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c DESC, shift + p, p) = 1"
    ),
}
