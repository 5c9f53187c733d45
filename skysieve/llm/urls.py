"""URL filter: rules by host and path, and a weighted vocabulary matched by an Aho-Corasick automaton.

Terms have weights. Strict ones weigh the limit or more and reject a URL at one hit; soft ones weigh less and reject when
the weights of the distinct terms that hit reach the limit: several of them. A hit counts only between boundaries: neither
neighbour of the term may be a letter or digit. A vocabulary may come from a table of terms and weights. Matching is done once a URL in one pass of the automaton.

Rules name a host and a path ("net/de/"). A rule fits its host and all subdomains where the URL's path starts with the
rule's path; the longest fitting rule decides, before the vocabulary.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and is judged by the vocabulary
alone (null: allow); whole URLs of any length are matched; rows with a null id are judged like others; repeated rows repeat; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import table

# The rules of the query, and the default vocabulary with its weights.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
STRICT = ("porn", "porno", "xxx", "hentai", "escort", "warez", "phishing")
SOFT = ("adult", "sex", "nude", "casino", "betting", "poker", "viagra", "torrent", "crack", "loan", "free", "win")
#: Distinct soft terms that reject.
SOFT_HITS = 2


@dataclass
class Vocabulary:
    """Strict terms, soft terms (of weight 1, or with weights of their own below the limit) and the limit."""

    strict: Iterable[str] = STRICT
    soft: Iterable[str] | Mapping[str, int] = SOFT
    soft_hits: int = SOFT_HITS
    _made: list = field(default_factory=list, repr=False, compare=False)

    @classmethod
    def of(cls, terms: DataFrame, limit: int = SOFT_HITS) -> Vocabulary:
        """From a table (term, weight); the larger weight of a repeated term counts, terms without letters or digits don't.

        The terms travel to the tasks, so they must fit there."""
        rows = terms.where(F.col("term").isNotNull() & (F.col("weight") > 0)).groupBy(F.lower("term").alias("term")).agg(F.max("weight").cast("int").alias("weight")).collect()
        found = {r["term"]: r["weight"] for r in rows if any(map(str.isalnum, r["term"]))}
        return cls(tuple(t for t, w in found.items() if w >= limit), {t: w for t, w in found.items() if w < limit}, limit)

    def __getstate__(self) -> dict:
        return {"strict": self.strict, "soft": self.soft, "soft_hits": self.soft_hits, "_made": []}

    def weights(self) -> dict[str, int]:
        """Weights of the soft terms."""
        return dict(self.soft) if isinstance(self.soft, Mapping) else dict.fromkeys(self.soft, 1)

    def found(self, url: str | None) -> tuple[int, set[str]]:
        """(strict hits, distinct soft terms) of a URL in lower case."""
        if not url or not (self.strict or self.soft):
            return 0, set()
        if not self._made:
            automaton = ahocorasick.Automaton()
            for strict, terms in ((False, self.weights()), (True, self.strict)):
                for term in terms:
                    automaton.add_word(term, (term, strict))
            automaton.make_automaton()
            self._made.append(automaton)
        text, strict, soft = url.lower(), 0, set()
        for end, (term, is_strict) in self._made[0].iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            if is_strict:
                strict += 1
            else:
                soft.add(term)
        return strict, soft

    def hits(self, url: str | None) -> tuple[int, int, int]:
        """(strict hits, distinct soft terms, their weight) of a URL."""
        (strict, soft), weights = self.found(url), self.weights()
        return strict, len(soft), sum(weights[t] for t in soft)

    def rejects(self, url: str | None) -> bool:
        strict, _, weight = self.hits(url)
        return strict > 0 or weight >= self.soft_hits


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first "://" up to a slash, question mark, hash or the end; empty without "://"."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; empty without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule's text, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        site, _, where = rule.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit("/" + where))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_terms) of every row."""
    rules, vocabulary = RULES if rules is None else rules, vocabulary or Vocabulary()
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary.hits(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in found], pa.int32()) for k in range(3))], ["id", "url", "strict_hits", "soft_terms", "soft_weight"])

    hit = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(run, f"id {kind}, url string, strict_hits int, soft_terms int, soft_weight int")
    split = hit.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_weight") >= vocabulary.soft_hits), "block").otherwise("allow")
    decided = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], own) if rules else own
    return split.select("id", "host", "path", "rule", decided.alias("verdict"), "strict_hits", "soft_terms")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    def count(terms: tuple[str, ...], distinct: bool) -> str:
        each = "CAST(regexp_matches(u, '(^|[^\\p{L}\\p{N}])%s($|[^\\p{L}\\p{N}])') AS INTEGER)" if distinct else "CAST(len(regexp_extract_all(regexp_replace(u, '([^\\p{L}\\p{N}])', '\\1\\1', 'g'), '(^|[^\\p{L}\\p{N}])%s($|[^\\p{L}\\p{N}])')) AS INTEGER)"
        return " + ".join(each % t for t in terms)

    cases = " ".join(
        f"WHEN (host = '{s}' OR ends_with(host, '.{s}')) AND starts_with(path, '/{w}') THEN '{r}'"
        for r in sorted(RULES, key=lambda r: (-len(r), r))
        for s, _, w in [r.partition("/")]
    )
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES.items())
    return f"""
WITH a AS (SELECT page_id, coalesce(lower(url), '') AS u, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {cases} END AS rule, {count(STRICT, False)} AS strict_hits, {count(SOFT, True)} AS soft_terms FROM b)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN strict_hits * {SOFT_HITS} + soft_terms >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_terms FROM c
"""


ORACLE = _sql()
