"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes a sequence of tokens: words in lower case, and placeholders for
what a re-parameterised question would change: ``<num>`` for a number,
``<unit>`` for a unit of measure right after one, ``<name>`` for a run of
capitalised words, wherever in a sentence it stands and however many words it
has. Windows of eight consecutive tokens are hashed, and those of all documents
are hash-joined with those of the benchmark items. Windows of fewer than four
plain words are too common as templates; a second key on the plain lower-case
words of every window finds these and re-cased copies, whatever they hold.

Matches of a document and an item are put in order of their diagonal (place in
the document minus place in the item); neighbours at most ``BAND`` words apart
belong to one alignment, so words put in or left out don't end it. Within an
alignment the words behind the placeholders are paired, and the pairing must be
one-to-one: the same name or number in the item always stands for the same one
in the document. The pairing that most places hold wins, on both sides; template
windows that hold another one are dropped. Windows of equal words need no such
check. Accidental template matches rarely agree, re-parameterised copies do.

A document is contaminated by an item if the windows left in an alignment cover
at least half of the item's words, or 13 of them: an excerpt of that length
gives the item away.

Documents are first reduced to those that share any window with the benchmark:
its window hashes are broadcast, at most ``BROADCAST_ROWS`` at a time, in as many
passes as that takes. No token of the corpus is shuffled. The few documents left
are then aligned by shuffle joins.

Cases: null and empty texts have no tokens and match nothing; an item of fewer
than eight tokens is one window of all its tokens and matches a document that
holds it whole; repeated items (equal texts, or one item_id twice) are each
reported once per item_id; rows repeated in the documents are reported once per
doc_id; different texts under one doc_id are aligned apart, and the best counts;
at equal counts of pairings the least words win; null ids are ignored. Empty
tables give an empty result; extra columns are ignored. Very long texts are
windowed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glanage.llm.common import pick, saved, table

WINDOW = 8
#: Share of an item's words that an alignment must cover.
COVERAGE = 0.5
#: Words that are enough whatever their share.
ENOUGH = 13
#: Plain words that a template window must have.
PLAIN = 4
#: Words by which neighbouring matches of an alignment may be shifted.
BAND = 8
#: Benchmark window hashes that are broadcast at a time (8 bytes each, some 60 in a hash table).
BROADCAST_ROWS = 500_000
#: Numbers and words.
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{M}]*"
#: Units of measure, as fixed values.
UNITS = "kg g mg km m cm mm mi ft in lb oz l ml s min h hr ms km/h mph kmh usd eur gbp dollars euros percent hours minutes seconds days weeks months years metres meters kilometres kilometers miles feet inches pounds grams kilograms litres liters degrees".split()


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def _canonical(x: Column, before: Column) -> Column:
    """The template token for x after ``before`` (null: at the start)."""
    low, rest = F.lower(x), F.substring(x, 2, 1 << 30)
    unit = low.isin(UNITS) & F.coalesce(_is_number(before), F.lit(False))
    name = (low != x) & (rest != "") & (rest == F.lower(rest))
    return F.when(_is_number(x), "<num>").when(unit, "<unit>").when(name, "<name>").otherwise(low)


def _at(a: str, i: Column) -> Column:
    return F.get(F.col(a), i)


def tokenised(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, raw (lower-case words), t (a template token for each) and starts (where template tokens begin: runs of names are one)."""
    found = df.select(*keep, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("all"))
    t = F.transform("all", lambda x, i: _canonical(x, _at("all", i - 1)))
    found = found.select(*keep, F.transform("all", lambda x: F.lower(x)).alias("raw"), t.alias("t"))
    places = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: (_at("t", i) != "<name>") | (i == 0) | (_at("t", i - 1) != "<name>"))
    return found.select(*keep, "raw", "t", begins.alias("starts"))


def _starts(length: Column, w: int) -> Column:
    return F.when(length >= w, F.sequence(F.lit(0), length - w)).otherwise(F.array().cast("array<int>"))


def _hashes(tokens: DataFrame, keep: list[str], widths: list[tuple[str, int]], places: bool = True) -> DataFrame:
    """``keep`` columns and h of every window; with ``places`` also kind (place in ``widths``) and j (first token). Kind "t" has windows of template tokens, "r" of words."""
    tokens = tokens.select(*keep, F.transform("raw", lambda x: F.xxhash64(x)).alias("r"), F.transform("starts", lambda s: F.xxhash64(_at("t", s))).alias("t"))

    def windows(k: int, kind: str, w: int) -> Column:
        h = lambda j: F.xxhash64(F.lit(k), F.slice(kind, j + 1, w))
        return F.transform(_starts(F.size(kind), w), lambda j: F.struct(F.lit(k).alias("kind"), j.alias("j"), h(j).alias("h")) if places else h(j))

    found = F.explode(F.concat(*(windows(k, kind, w) for k, (kind, w) in enumerate(widths))))
    return tokens.select(*keep, found.alias("m")).select(*keep, "m.*") if places else tokens.select(*keep, found.alias("h"))


def _windows(tokens: DataFrame, keep: list[str], widths: list[tuple[str, int]]) -> DataFrame:
    """``keep`` columns, kind, h, lo and hi (words from and to) and slots (of template windows: place and words of each placeholder)."""
    end = lambda j: F.coalesce(_at("starts", j), F.size("raw"))
    spans = F.transform("starts", lambda s, j: F.struct(s.alias("lo"), end(j + 1).alias("hi"), _at("t", s).alias("t")))
    slots = F.transform(spans, lambda x: F.struct(x["lo"].alias("p"), F.when(x["t"].startswith("<"), F.array_join(F.slice("raw", x["lo"] + 1, x["hi"] - x["lo"]), " ")).alias("v")))
    flat = tokens.select(*keep, "raw", "t", "starts", slots.alias("all_slots"))
    carried = _hashes(flat, [*keep, "raw", "starts", "all_slots"], widths)
    width = F.element_at(F.array(*(F.lit(w) for _, w in widths)), F.col("kind") + 1)
    template = F.element_at(F.array(*(F.lit(kind == "t") for kind, _ in widths)), F.col("kind") + 1)
    lo = F.when(template, _at("starts", F.col("j"))).otherwise(F.col("j"))
    hi = F.when(template, F.coalesce(_at("starts", F.col("j") + width), F.size("raw"))).otherwise(F.col("j") + width)
    own = F.when(template, F.slice("all_slots", F.col("j") + 1, width)).otherwise(F.slice("all_slots", 1, 0))
    return carried.select(*keep, "kind", "h", lo.alias("lo"), hi.alias("hi"), own.alias("slots"), template.alias("template"))


def _candidates(docs: DataFrame, hashes: DataFrame, widths: list[tuple[str, int]]) -> DataFrame:
    """(id, th) of the documents that share a window with the benchmark."""
    parts = -(-hashes.count() // BROADCAST_ROWS)
    tokens, found = tokenised(docs, "id", "th"), None
    for k in range(parts):
        own = hashes.where(F.pmod("h", F.lit(parts)) == k) if parts > 1 else hashes
        one = _hashes(tokens, ["id", "th"], widths, places=False).join(F.broadcast(own), "h", "left_semi").select("id", "th")
        found = one if found is None else found.unionByName(one)
    return saved(found.distinct(), "candidates")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per contaminated document and item.

    ``docs`` has doc_id and text, ``items`` has item_id and text. Returns
    doc_id, item_id, item_tokens (its words), covered (those in the best
    alignment), slots (placeholders among them).
    """
    rows = pick(docs, id="doc_id", text="text").where("id is not null").withColumn("th", F.xxhash64("text"))
    keyed = tokenised(pick(items, id="item_id", text="text").where("id is not null"), "id").where(F.size("raw") > 0)
    # Items of equal tokens behave alike: they are matched once.
    keyed = saved(keyed.withColumn("form", F.md5(F.concat_ws("\n", F.array_join("raw", " "), F.array_join("t", " ")))), "items")
    forms = keyed.groupBy("form").agg(*(F.first(c).alias(c) for c in ("raw", "t", "starts")))
    forms = saved(forms, "forms")
    sizes = forms.agg(F.collect_set(F.least(F.size("starts"), F.lit(WINDOW))).alias("t"), F.collect_set(F.least(F.size("raw"), F.lit(WINDOW))).alias("r")).first()
    widths = [(kind, w) for kind in ("t", "r") for w in sorted(sizes[kind])]
    if not widths:
        return keyed.sparkSession.createDataFrame([], "doc_id long, item_id long, item_tokens int, covered int, slots int")
    own = _windows(forms.select("form", "raw", "t", "starts", F.size("raw").alias("n"), F.size("starts").alias("n_t")), ["form", "n", "n_t"], widths)
    width = F.element_at(F.array(*(F.lit(w) for _, w in widths)), F.col("kind") + 1)
    right = width == F.least(F.when(F.col("template"), F.col("n_t")).otherwise(F.col("n")), F.lit(WINDOW))
    plain = width - F.size(F.filter("slots", lambda s: s["v"].isNotNull()))
    own = own.where(right & (~F.col("template") | (plain >= F.least(width, F.lit(PLAIN)))))
    own = saved(own.select("form", "n", "h", F.col("lo").alias("ilo"), F.col("hi").alias("ihi"), F.col("slots").alias("islots")), "windows")
    candidates = _candidates(rows, own.select("h").distinct(), widths)
    texts = tokenised(rows.join(candidates, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]), "id", "th")
    met = _windows(texts, ["id", "th"], widths).join(own, "h")
    pairs = F.filter(F.arrays_zip("islots", "slots"), lambda z: z["islots"]["v"].isNotNull())
    met = met.select("id", "th", "form", "n", "ilo", "ihi", (F.col("lo") - F.col("ilo")).alias("diagonal"), F.transform(pairs, lambda z: F.struct(z["islots"]["p"].alias("p"), z["islots"]["v"].alias("a"), z["slots"]["v"].alias("b"))).alias("pairs"))
    group = ["id", "th", "form", "n"]
    along = Window.partitionBy(*group).orderBy("diagonal")
    met = met.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > BAND).cast("int"), F.lit(0)))
    met = met.withColumn("part", F.sum("new").over(along.rangeBetween(Window.unboundedPreceding, 0))).drop("new", "diagonal")
    met = saved(met.distinct(), "matches")
    group.append("part")
    # The pairing that most places hold, on both sides.
    votes = met.select(*group, F.explode("pairs").alias("s")).groupBy(*group, "s.a", "s.b").agg(F.count_distinct("s.p").alias("c"))
    of_a = Window.partitionBy(*group, "a").orderBy(F.desc("c"), "b")
    of_b = Window.partitionBy(*group, "b").orderBy(F.desc("c"), "a")
    wrong = votes.withColumn("ra", F.row_number().over(of_a)).withColumn("rb", F.row_number().over(of_b)).where("ra > 1 or rb > 1")
    wrong = wrong.groupBy(*group).agg(F.collect_set(F.struct("a", "b")).alias("wrong"))
    kept = met.join(wrong, group, "left")
    bad = F.exists("pairs", lambda s: F.array_contains("wrong", F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    kept = kept.where(F.col("wrong").isNull() | ~bad)
    covered = kept.groupBy(*group).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("ilo", F.col("ihi") - 1))))).alias("covered"),
        F.size(F.array_distinct(F.flatten(F.collect_set("pairs.p")))).alias("slots"),
    )
    covered = covered.where(F.col("covered") >= F.least(COVERAGE * F.col("n"), F.lit(ENOUGH)))
    best = covered.groupBy("id", "form", F.col("n").alias("item_tokens")).agg(F.max(F.struct("covered", "slots")).alias("m"))
    best = best.select(F.col("id").alias("doc_id"), "form", "item_tokens", "m.covered", "m.slots")
    return best.join(keyed.select("form", F.col("id").alias("item_id")).distinct(), "form").select(
        F.col("doc_id").cast("long"), F.col("item_id").cast("long"), "item_tokens", "covered", "slots"
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


_SQL_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _sql_tokens(name: str, key: str) -> str:
    """rid, id, raw, tt (template tokens), st (their first words) and sf (the words of each)."""
    return f"""
    select rid, id, raw, st, list_transform(st, lambda s: t[s + 1]) as tt,
      list_transform(range(1, len(st) + 1), lambda j: array_to_string(raw[st[j] + 1:coalesce(st[j + 1], len(raw))], ' ')) as sf
    from (
      select *, list_filter(range(0, len(t)), lambda i: i = 0 or t[i + 1] <> '<name>' or t[i] <> '<name>') as st from (
        select rid, id, list_transform(a, lambda x: lower(x)) as raw, list_transform(range(1, len(a) + 1), lambda i:
          case when a[i] >= '0' and a[i] < ':' then '<num>'
               when i > 1 and a[i - 1] >= '0' and a[i - 1] < ':' and lower(a[i]) in ({_SQL_UNITS}) then '<unit>'
               when lower(a[i]) <> a[i] and length(a[i]) > 1 and lower(substr(a[i], 2)) = substr(a[i], 2) then '<name>'
               else lower(a[i]) end) as t
        from (select row_number() over () as rid, id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') as a
              from (select distinct {key} as id, text from {name} where {key} is not null))))"""


def _sql_windows(of: str, widths: str) -> str:
    """Windows of the token table ``of``, of the widths that ``widths`` joins: kind, w, key, lo, hi and slots."""
    return f"""
    select rid, 't' as kind, w, array_to_string(tt[j + 1:j + w], ' ') as key, st[j + 1] as lo, coalesce(st[j + w + 1], len(raw)) as hi,
      list_transform(list_filter(range(j + 1, j + w + 1), lambda i: tt[i][1] = '<'), lambda i: {{'p': st[i], 'v': sf[i]}}) as slots
    from (select x.*, y.w, unnest(range(0, len(tt) - y.w + 1)) as j from {of} x, ({widths.format(n="tt")}) y)
    union all
    select rid, 'r', w, array_to_string(raw[j + 1:j + w], ' '), j, j + w, []
    from (select x.*, y.w, unnest(range(0, len(raw) - y.w + 1)) as j from {of} x, ({widths.format(n="raw")}) y)"""


ORACLE = f"""
with d as materialized ({_sql_tokens("documents", "doc_id")}),
b as materialized (select * from ({_sql_tokens("benchmark", "item_id")}) where len(raw) > 0),
bw as materialized (
  select bw.*, len(b.raw) as n from ({_sql_windows("b", "select distinct least(len({n}), " + str(WINDOW) + ") as w from b")}) bw join b using (rid)
  where w = least(case when kind = 't' then len(b.tt) else len(b.raw) end, {WINDOW}) and (kind = 'r' or w - len(slots) >= least(w, {PLAIN}))),
dw as ({_sql_windows("d", "select distinct least(len({n}), " + str(WINDOW) + ") as w from b")}),
m as materialized (
  select dw.rid as did, bw.rid as bid, bw.n, bw.lo as ilo, bw.hi as ihi, dw.lo - bw.lo as diagonal,
    list_transform(range(1, len(bw.slots) + 1), lambda i: {{'p': bw.slots[i].p, 'a': bw.slots[i].v, 'b': dw.slots[i].v}}) as pairs
  from dw join bw on dw.kind = bw.kind and dw.w = bw.w and dw.key = bw.key),
al as materialized (
  select *, sum(fresh) over (partition by did, bid order by diagonal range between unbounded preceding and current row) as part
  from (select *, case when diagonal - lag(diagonal) over (partition by did, bid order by diagonal) > {BAND} then 1 else 0 end as fresh from m)),
votes as (
  select did, bid, part, s.a as a, s.b as b, count(distinct s.p) as c from (select did, bid, part, unnest(pairs) as s from al) group by all),
wrong as (
  select did, bid, part, list({{'a': a, 'b': b}}) as wrong from (
    select *, row_number() over (partition by did, bid, part, a order by c desc, b) as ra, row_number() over (partition by did, bid, part, b order by c desc, a) as rb from votes)
  where ra > 1 or rb > 1 group by all),
kept as (
  select al.* from al left join wrong using (did, bid, part)
  where wrong is null or len(list_filter(pairs, lambda s: list_contains(wrong, {{'a': s.a, 'b': s.b}}))) = 0),
covered as (
  select did, bid, n, part, len(list_distinct(flatten(list(range(ilo, ihi))))) as covered, len(list_distinct(flatten(list(list_transform(pairs, lambda s: s.p))))) as slots
  from kept group by all),
r as (
  select d.id as doc_id, b.id as item_id, n as item_tokens, covered, slots,
    row_number() over (partition by d.id, b.id order by covered desc, slots desc) as k
  from covered join d on d.rid = did join b on b.rid = bid where covered >= least({COVERAGE} * n, {ENOUGH}))
select doc_id, item_id, cast(item_tokens as int) as item_tokens, cast(covered as int) as covered, cast(slots as int) as slots
from r where k = 1
"""
