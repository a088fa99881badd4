"""Duplicate postings: source identity, conservative groups within one address, merge.

Postings have source, source_job_id, url, company, title, published_at, location, workplace_type, employment_type
and description; attributes that must agree wherever one side has them (department, unit, ids of the system) are
named by the caller. Nulls and empty strings both count as absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import canonical
from tidewell.functions.urls import canonical_url, names_posting
from tidewell.session import written
from tidewell.sources.html import settled

#: Company names that say nothing.
GENERIC_COMPANIES = ("gupy", "99jobs", "vagas com", "empresa nao identificada", "ciee empresa nao identificada")
#: What a date of publication weighs against characters of description and location.
DATE_WEIGHT = 100
FILLED = ("location", "published_at", "workplace_type", "employment_type", "description")
LOOSE = ("published_at", "location", "workplace_type", "employment_type", "description")


def _present(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string") != "", F.lit(False))


def richness(description: str = "description", location: str = "location", published_at: str = "published_at") -> Column:
    """Characters of description and location, and a fixed weight for a date."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return size(description) + size(location) + F.when(_present(published_at), DATE_WEIGHT).otherwise(0)


def identified(rows: DataFrame) -> Column:
    """The source's own name of a posting, null where source or id is absent."""
    return F.when(_present("source") & _present("source_job_id"), F.struct("source", "source_job_id"))


def fingerprint() -> Column:
    """SHA-256 that names a posting: by source and id, else by source, address, title and location."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    listed = lambda *names: F.concat(F.lit("["), F.concat_ws(", ", *map(quoted, names)), F.lit("]"))
    return F.sha2(F.when(_present("source") & _present("source_job_id"), listed("source", "source_job_id")).otherwise(listed("source", "url", "title", "location")), 256)


def winners(rows: DataFrame, keys: list[str], rich: Column, position: str) -> DataFrame:
    """The richest row of each key, the first in input order on a tie. Partial aggregates meet, not rows."""
    best = F.max_by(F.struct(*rows.columns), F.struct(rich, -F.col(position)))
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(best.alias("w")).select("w.*")


def gap_filled(rows: DataFrame, keys: list[str], columns: list[str], position: str) -> DataFrame:
    """First value of each column in input order that isn't null or empty."""
    first = lambda c: F.min_by(c, F.when(_present(c), F.col(position))).alias(c)
    return rows.groupBy(*keys).agg(*map(first, columns))


def merged(rows: DataFrame, group: str, position: str) -> DataFrame:
    """One row for each group: its richest member, and, where members come from several sources, the first value of
    the others in each of its gaps. ``references`` keeps every member's address."""
    best = F.max_by(F.struct(*rows.columns), F.struct(richness(), -F.col(position))).alias("w")
    first = [F.min_by(c, F.when(_present(c), F.col(position))).alias(f"first_{c}") for c in FILLED]
    low, high = F.min(F.coalesce("source", F.lit(""))).alias("low"), F.max(F.coalesce("source", F.lit(""))).alias("high")
    merged_rows = rows.groupBy(F.col(group).alias("__group")).agg(best, low, high, *first)
    fill = lambda c: F.when(~_present(f"w.{c}") & (F.col("low") != F.col("high")), F.coalesce(f"first_{c}", f"w.{c}")).otherwise(F.col(f"w.{c}")).alias(c)
    return merged_rows.select(*(fill(c) if c in FILLED else F.col(f"w.{c}") for c in rows.columns))


def references(rows: DataFrame, group: str) -> DataFrame:
    """Distinct (group, source, source_job_id, url), one row each: a group's set may be large."""
    return rows.where("source is not null and source_job_id is not null and url is not null").select(group, "source", "source_job_id", "url").distinct()


def carried(rows: DataFrame) -> Column:
    """All (source, source_job_id, url) that a row stands for: its own and, in a column ``source_references``, those merged into it."""
    kind = "array<struct<source:string,source_job_id:string,url:string>>"
    own = F.when(F.col("source").isNotNull() & F.col("source_job_id").isNotNull() & F.col("url").isNotNull(), F.array(F.struct("source", "source_job_id", "url")))
    held = F.col("source_references") if "source_references" in rows.columns else F.lit(None)
    return F.concat(F.coalesce(held.cast(kind), F.array().cast(kind)), F.coalesce(own, F.array().cast(kind)))


def merged_with_references(rows: DataFrame, group: str, position: str) -> DataFrame:
    """:func:`merged` rows with ``source_references``, the sorted set of all references of a group's members and of those
    merged into them before. Sets meet in partial aggregates, so that merging in steps gives what merging at once does."""
    held = rows.withColumn("__held", carried(rows)).groupBy(F.col(group).alias("__group")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__held")))).alias("source_references"))
    plain = merged(rows.drop("source_references"), group, position)
    return plain.join(held, plain[group].eqNullSafe(held["__group"])).drop("__group")


def source_deduplicated(rows: DataFrame, position: str) -> DataFrame:
    """Rows with repeated (source, id) merged; every row without them stays on its own."""
    key = F.coalesce(F.to_json(identified(rows)), F.concat(F.lit("row "), F.col(position).cast("string")))
    return merged(rows.withColumn("__key", key), "__key", position).drop("__key")


def new_rows(combined: DataFrame, base: DataFrame) -> DataFrame:
    """Rows whose (source, id) the base hasn't; those without count as new."""
    known = base.select("source", "source_job_id").where(_present("source") & _present("source_job_id"))
    return combined.join(known.distinct(), ["source", "source_job_id"], "left_anti").select(*combined.columns)


def comparable(rows: DataFrame, strict: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the keys by which postings are compared: address, company and title (null where they say
    nothing), loose attributes (null where absent) and strict ones (an empty string where absent)."""
    read = {"url_key": canonical_url(F.col("url")), "company_key": canonical(F.col("company")), "title_key": canonical(F.col("title")), "id_key": F.to_json(identified(rows))}
    if "source_references" in rows.columns:
        read["id_set"] = F.filter(carried(rows), lambda r: (r["source"] != "") & (r["source_job_id"] != ""))
    read |= {f"{c}_key": F.when(_present(c), F.col(c).cast("string") if c == "published_at" else canonical(F.col(c))) for c in LOOSE}
    read |= {f"{c}_key": canonical(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in strict}
    telling = F.col("company_key") != "", ~F.col("company_key").isin(*GENERIC_COMPANIES)
    # in a stage of their own, so that keys are computed once
    return rows.withColumns(read).withColumns({"url_key": F.when(names_posting(F.col("url_key")), F.col("url_key")), "company_key": F.when(telling[0] & telling[1], F.col("company_key")), "title_key": F.nullif("title_key", F.lit(""))})


def conflict(a: str, b: str, strict: tuple[str, ...] = (), sets: bool = False) -> Column:
    """The first reason why two comparable rows, in columns ``a`` and ``b``, are no one posting; null if they may be.

    With ``sets`` merged rows conflict by every id that they carry: one source with two ids among both.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    if sets:
        ids = F.exists(x("id_set"), lambda i: F.exists(y("id_set"), lambda j: (i["source"] == j["source"]) & (i["source_job_id"] != j["source_job_id"])))
    else:
        ids = (x("source") == y("source")) & (x("id_key") != y("id_key"))
    reason = F.when(F.coalesce(ids, F.lit(False)), "id")
    for c in ("company", "title"):
        reason = reason.when(~F.coalesce(x(f"{c}_key") == y(f"{c}_key"), F.lit(False)), c)
    for c in LOOSE:
        reason = reason.when(F.coalesce(x(f"{c}_key") != y(f"{c}_key"), F.lit(False)), c)
    for c in strict:
        reason = reason.when(x(f"{c}_key") != y(f"{c}_key"), c)
    return reason


class FirstFit:
    """First fit with complete linkage for the rows of one bucket, which come in input order.

    A group is known by the sources in it and, for each loose attribute, by the one value that any member has; so a
    row fits where its source is new and no value differs. For every set of attributes that rows have, groups are
    listed by their values of these; a source's rows never look twice at a group that already has the source.
    """

    def __init__(self) -> None:
        self.heads: list[int] = []
        self.values: list[list] = []
        self.sources: list[set] = []
        self.lists: dict[tuple, dict[tuple, list[int]]] = {}
        self.read: dict[tuple, dict] = {}

    def _list(self, have: tuple[int, ...]) -> dict[tuple, list[int]]:
        if have not in self.lists:
            listed = self.lists[have] = {}
            for g, values in enumerate(self.values):
                listed.setdefault(tuple(values[i] for i in have), []).append(g)
        return self.lists[have]

    def place(self, position: int, source: str | None, values: list) -> int:
        have = tuple(i for i, v in enumerate(values) if v is not None)
        listed, best = self._list(have), None
        for mask in range(1 << len(have)):
            key = tuple(values[i] if mask >> k & 1 else None for k, i in enumerate(have))
            groups = listed.get(key)
            if not groups:
                continue
            readers = self.read.setdefault((have, key), {})
            at = readers.get(source, 0)
            while at < len(groups) and (source in self.sources[groups[at]] or tuple(self.values[groups[at]][i] for i in have) != key):
                at += 1  # it has the source for good, or has more values by now and stands in another list
            readers[source] = at
            if at < len(groups) and (best is None or groups[at] < best):
                best = groups[at]
        if best is None:
            best = len(self.heads)
            self.heads.append(position)
            self.values.append(list(values))
            self.sources.append(set())
            for h, listed in self.lists.items():
                listed.setdefault(tuple(values[i] for i in h), []).append(best)
        else:
            filled = [v if v is not None else w for v, w in zip(self.values[best], values, strict=True)]
            if filled != self.values[best]:
                for h, listed in self.lists.items():
                    old, new = tuple(self.values[best][i] for i in h), tuple(filled[i] for i in h)
                    if old != new:
                        self._insert(h, new, listed.setdefault(new, []), best)
                self.values[best] = filled
        if source is not None:
            self.sources[best].add(source)
        return self.heads[best]

    def _insert(self, have: tuple, key: tuple, groups: list[int], group: int) -> None:
        """Puts a group at its place in a list and sets back those readers that are past it."""
        at = next((k for k in range(len(groups), 0, -1) if groups[k - 1] < group), 0)
        groups.insert(at, group)
        readers = self.read.get((have, key), {})
        for source, read in readers.items():
            if read > at:
                readers[source] = at


def grouped(rows: DataFrame, position: str, strict: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (of distinct source identity) with ``group_position``, the first member of each row's group.

    In input order a row joins the first group of its address with every member of which it is compatible; rows
    without a detail address, a telling company or a title stand alone. Company, title and strict attributes are equal
    within a group and so part an address's rows; so does a loose attribute that no row of such a bucket lacks.
    If all rows of a bucket then agree, each source's n-th row belongs to the n-th group, which ranks tell: a hot
    address, however many ids it has, is a sort. Other buckets are streamed, sorted, through :class:`FirstFit`,
    which holds the groups of one bucket, never its rows; one bucket of this kind is one task's work.
    """
    loose = [f"{c}_key" for c in LOOSE]
    keyed = comparable(rows, strict)
    by = ["url_key", "company_key", "title_key", *(f"{c}_key" for c in strict)]
    full = F.col("url_key").isNotNull() & F.col("company_key").isNotNull() & F.col("title_key").isNotNull()
    # a filter on the keys themselves would compute them once more below it
    slim = settled(
        keyed, [], bucket=F.when(full, F.sha2(F.to_json(F.struct(*by)), 256)), at=F.col(position).cast("long"), origin=F.when(F.col("id_key").isNotNull(), F.col("source")),
        **{c: F.when(F.col(c).isNotNull(), F.sha2(c, 256)) for c in loose},
    ).where("bucket is not null")
    # read several times below; rows that agree in bucket and loose attributes are of one kind
    slim = written(slim.withColumn("kind", F.sha2(F.to_json(F.struct("bucket", *loose)), 256)), "grouped")
    kinds = slim.groupBy("kind").agg(F.first("bucket").alias("bucket"), F.count("*").alias("n"), F.bool_and(F.col("origin").isNotNull()).alias("named"), *(F.first(c).alias(c) for c in loose))
    lacks = kinds.groupBy("bucket").agg(F.sum("n").alias("in_bucket"), *(F.max(F.col(c).isNull()).alias(f"lacks_{c}") for c in loose))
    whole = kinds.join(lacks.where("in_bucket > 1"), "bucket")
    whole = whole.withColumn("part", F.sha2(F.to_json(F.struct("bucket", *(F.when(~F.col(f"lacks_{c}"), F.col(c)).alias(c) for c in loose))), 256))
    # a part that is one kind agrees in all
    of_part = whole.groupBy("part").agg(F.sum("n").alias("in_part"), (F.bool_and("named") & (F.count("*") == 1)).alias("even"))
    listed = whole.select("kind", "part", *loose).join(of_part.where("in_part > 1").select("part", "even"), "part")
    parts = slim.select("kind", "at", "origin").join(listed, "kind").select("part", "at", "origin", "even", *loose)
    parts = written(parts, "grouped-parts")
    ranked = parts.where("even").withColumn("r", F.row_number().over(Window.partitionBy("part", "origin").orderBy("at")))
    heads = ranked.groupBy("part", "r").agg(F.min("at").alias("group_position"))
    by_rank = ranked.join(heads, ["part", "r"]).select("at", "group_position")

    def first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, fit = None, FirstFit()
        for batch in batches:
            found = []
            for p, at, origin, *values in batch.itertuples(index=False, name=None):
                if p != part:
                    part, fit = p, FirstFit()
                found.append(fit.place(at, origin, values))
            yield pd.DataFrame({"at": batch["at"], "group_position": pd.Series(found, dtype="int64")})

    mixed = parts.where("not even").select("part", "at", "origin", *loose).repartition("part").sortWithinPartitions("part", "at")
    placed = by_rank.unionByName(mixed.mapInPandas(first_fit, "at long, group_position long"))
    return rows.join(placed, F.col(position) == F.col("at"), "left").select(*rows.columns, F.coalesce("group_position", F.col(position).cast("long")).alias("group_position"))


def representative(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The earliest row of each group."""
    least = F.min(F.struct(*order, F.struct(*rows.columns).alias("row"))).alias("m")
    return rows.groupBy(F.col(group).alias("__group")).agg(least).select("m.row.*")


def first_occurrences(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key in input order."""
    first = F.min(F.struct(position, F.struct(*rows.columns).alias("row"))).alias("first")
    return rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(first).select("first.row.*")
