"""How sources differ from their language, and from each other, in the terms they use.

Every (lang, source) group gives each term kept for its language a smoothed share. The terms that most set a group apart from its language are
found by a dominance skyband: a term's value grows with its count in the group and falls with its count in the language, so a term that k
others beat or equal in both and precede in bytes cannot be among the first k. Partitions of a group's terms keep the terms that fewer
than k others dominate; what they keep is merged and thinned again until one partition is left, and only that is ranked by exact arithmetic.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialised

from .common import broadcast_if_light, map_groups

LEAST_DOCUMENTS = 30
TOP = 50
KEPT_TERMS = 300_000
SKYBAND_TERMS = 50_000
MERGED_PARTS = 16
PAIR_TERMS = 100_000
_TILE = 4_000_000
_CHUNK_BYTES = 1 << 20
_NOT_IN_TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
"""Only A-Z are lowered; bytes that belong to no term become blanks."""


def _parts_of(text: bytes):
    """The lowered text in parts of about a megabyte, cut between terms."""
    at = 0
    while len(text) - at > _CHUNK_BYTES and (cut := text.find(b" ", at + _CHUNK_BYTES)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count_terms(batches):
    """For each (lang, source, term) its occurrences and documents; a row without term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def frame() -> pd.DataFrame:
        rows = [(*group, None, 0, 0) for group in counts]
        for group, (occurrences, documents) in counts.items():
            rows += [(*group, term.decode("utf-8", "surrogatepass"), n, documents[term]) for term, n in occurrences.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "documents"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            occurrences, documents = counts.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(occurrences), set()
            for part in _parts_of(text.encode("utf-8", "surrogatepass").translate(_NOT_IN_TERMS)):
                words = part.split(b" ")
                occurrences.update(words)
                own.update(words)
            occurrences.pop(b"", None)
            own.discard(b"")
            documents.update(own)
            held += len(occurrences) - before
            if held > KEPT_TERMS:
                yield frame()
                held = 0
    yield frame()


def skyband(group: np.ndarray, lang: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the points that fewer than k others dominate (group count at least, language count at most, place before).

    Dominators come first in the order of this loop, and k of them are kept if there are k at all, because dominance is transitive.
    """
    kept = []
    langs, places, size = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    for i in np.lexsort((place, lang, -group)):
        if size >= k and np.count_nonzero((langs[:size] <= lang[i]) & (places[:size] < place[i])) >= k:
            continue
        if size == len(langs):
            langs, places = np.concatenate((langs, langs)), np.concatenate((places, places))
        langs[size], places[size], size = lang[i], place[i], size + 1
        kept.append(i)
    return np.array(kept, np.int64)


def _thin(k: int):
    def work(key, columns):
        terms, n, lang_n = columns
        order = sorted(range(len(terms)), key=lambda i: terms[i].encode("utf-8", "surrogatepass"))
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        for i in skyband(np.array(n, np.int64), np.array(lang_n, np.int64), place, k):
            yield (*key, terms[i], n[i], lang_n[i])

    return work


def skybands(counts: DataFrame, k: int, part_terms: int = SKYBAND_TERMS) -> DataFrame:
    """Of (lang, source, term, n, lang_n) the rows that fewer than k others of their group dominate, merged from partitions of a group."""
    columns = ["lang", "source", "term", "n", "lang_n"]
    sizes = counts.groupBy("lang", "source").agg(F.ceil(F.count(F.lit(1)) / part_terms).alias("parts"))
    parts = sizes.agg(F.max("parts")).first()[0] or 1
    dealt = counts.join(broadcast_if_light(sizes), ["lang", "source"]).withColumn(
        "sky_part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    )
    schema = "lang string, source string, sky_part int, term string, n long, lang_n long"
    while True:
        kept = map_groups(dealt, ["lang", "source", "sky_part"], ["term", "n", "lang_n"], _thin(k), schema)
        if parts <= 1:
            return kept.select(*columns)
        dealt = materialised(kept.withColumn("sky_part", (F.col("sky_part") / MERGED_PARTS).cast("int")), "skyband")
        parts = -(-parts // MERGED_PARTS)


def _pair_sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences between all sources over one part of a language's terms."""
    sources = right["source"].tolist()
    rest = right["zero_share"].to_numpy(np.int64)
    at = {source: i for i, source in enumerate(sources)}
    codes, terms = pd.factorize(left["term"])
    column = left["source"].map(at).to_numpy(np.int64) if len(left) else np.zeros(0, np.int64)
    share = left["share"].to_numpy(np.int64)
    total = np.zeros((len(sources), len(sources)), np.int64)
    step = max(1, _TILE // max(1, len(sources)))
    order = np.argsort(codes, kind="stable")
    for first in range(0, len(terms), step):
        own = order[np.searchsorted(codes[order], first) : np.searchsorted(codes[order], first + step)]
        tile = np.tile(rest, (min(step, len(terms) - first), 1))
        tile[codes[own] - first, column[own]] = share[own]
        for i in range(len(sources)):
            total[i] += np.abs(tile - tile[:, i : i + 1]).sum(axis=0)
    here, there = np.nonzero(~np.eye(len(sources), dtype=bool))
    names = np.array(sources, dtype=object)
    return pd.DataFrame({"lang": key[0], "source": names[here], "item": names[there], "value": total[here, there]})


_SHARE = "1 + ((1000000000BD * cast({n} + 5 as decimal(20, 0))) div cast({of} + 5 * v as decimal(20, 0)))"


def source_divergence(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, part_terms: int = SKYBAND_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: what sets every (lang, source) group apart.

    Terms are runs of letters and non-ASCII characters, A-Z lowered; a language keeps those in at least ``least_documents`` of its documents
    (V of them). A share is 1 + floor(10^9 * (count + 5) / (N + 5 * V)) with the count in the group or language and N the sum of counts over
    kept terms. Part ``pair``: for every other source of the language the sum of absolute differences of shares over all kept terms
    (0 if there are none). Part ``term``: the kept terms of the group whose share exceeds that of the language, by the difference,
    the first ``top``. Ties go to the earlier item in UTF-8.

    Null text, lang and source are read as ''. Repeated rows count as often as they occur; a document counts once for a term. Groups without
    terms have pairs only; an empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    rows = documents.selectExpr("coalesce(lang, '') as lang", "coalesce(source, '') as source", "coalesce(text, '') as text")
    counted = rows.mapInPandas(_count_terms, "lang string, source string, term string, n long, documents long")
    counts = materialised(
        counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "terms"
    )
    kept_terms = materialised(
        counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("d"))
        .where(f"d >= {int(least_documents)}").drop("d"),
        "kept-terms",
    )
    kept = materialised(counts.join(broadcast_if_light(kept_terms), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    langs = kept_terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = materialised(
        spark.sql(
            """
            with g as (select distinct lang, source from {counts} where term is null),
            own as (select lang, source, sum(n) as total from {kept} group by lang, source)
            select lang, source, coalesce(total, 0) as total, coalesce(v, 0) as v, coalesce(lang_total, 0) as lang_total
            from g left join own using (lang, source) left join {langs} using (lang)
            """,
            counts=counts, kept=kept, langs=langs,
        ),
        "groups",
    )
    light = broadcast_if_light(groups)
    share = _SHARE.format(n="n", of="total")
    shares = kept.join(light, ["lang", "source"]).selectExpr("lang", "source", "term", f"{share} as share", "v")

    best = skybands(kept, top, part_terms).join(light, ["lang", "source"]).selectExpr(
        "lang", "source", "'term' as part", "term as item", f"{share} - ({_SHARE.format(n='lang_n', of='lang_total')}) as value"
    ).where("value > 0")

    # a language's terms are dealt into parts, and each part meets all sources of the language
    many = "cast(greatest(1, ceil(v / {0})) as int)".format(PAIR_TERMS)
    left = shares.selectExpr("lang", "source", "term", "share", f"pmod(xxhash64(term), {many}) as pair_part")
    zero = f"case when v = 0 then 0 else {_SHARE.format(n='0', of='total')} end"
    right = groups.selectExpr("lang", "source", f"{zero} as zero_share", f"explode(sequence(0L, {many} - 1L)) as pair_part")
    sums = left.groupBy("lang", "pair_part").cogroup(right.groupBy("lang", "pair_part")).applyInPandas(
        _pair_sums, "lang string, source string, item string, value long"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).selectExpr(
        "lang", "source", "'pair' as part", "item", "value"
    )
    return spark.sql(
        f"""
        with ranked as (
          select *, row_number() over (partition by lang, source order by value desc, item) as rank from {{best}}
          union all
          select *, row_number() over (partition by lang, source order by value desc, item) as rank from {{pairs}})
        select lang, source, part, item, cast(value as bigint) as value, rank from ranked where part = 'pair' or rank <= {int(top)}
        """,
        best=best, pairs=pairs,
    )
