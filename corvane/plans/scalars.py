"""Scalar, array, bit and text functions, and the kernels that need Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fx
from ..operators import bits, rangejoin, signal as sig
from ..operators.peaks import binned
from ..operators.ranking import numbered, quantiles, running_before, with_neighbours
from ..sources import audio, readers
from ..sources.tables import fingerprints, peaks
from .registry import plan


@plan("scf01_split", "select o_orderkey, split_part(o_orderpriority, '-', 2) as word from orders")
def _(t):
    return t.orders.select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("word"))


@plan("scf02_split_last", r"select p_partkey, regexp_extract(p_brand || '_' || p_type || '_' || p_size, '^(.*)_([^_]*)$', 1) as head, regexp_extract(p_brand || '_' || p_type || '_' || p_size, '^(.*)_([^_]*)$', 2) as tail from part")
def _(t):
    head, tail = fx.split_last(F.concat_ws("_", "p_brand", "p_type", F.col("p_size").cast("string")))
    return t.part.select("p_partkey", head.alias("head"), tail.alias("tail"))


@plan("scf03_trim_lower", "select n_nationkey::bigint as n_nationkey, lower(trim('  ' || n_name || ' ')) as name from nation")
def _(t):
    return t.nation.select("n_nationkey", F.lower(F.trim(F.concat(F.lit("  "), "n_name", F.lit(" ")))).alias("name"))


@plan("scf04_prefix_suffix", "select page_id, starts_with(url, 'https') as secure, ends_with(url, 'top') as top from pages")
def _(t):
    return t.pages.select("page_id", F.startswith("url", F.lit("https")).alias("secure"), F.endswith("url", F.lit("top")).alias("top"))


@plan("scf05_replace", "select page_id, regexp_replace(replace(url, 'https://', ''), '#.*$', '') as bare from pages")
def _(t):
    return t.pages.select("page_id", F.regexp_replace(F.replace("url", F.lit("https://"), F.lit("")), "#.*$", "").alias("bare"))


@plan("scf06_row_ids", "select c_custkey, c_mktsegment || '_' || c_nationkey::varchar as row_id from customer")
def _(t):
    return t.customer.select("c_custkey", F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("row_id"))


@plan("scf07_lengths", "select doc_id, length(text)::bigint as n, substr(text, 1, 14) as head from documents where text is not null")
def _(t):
    return t.documents.where("text is not null").select("doc_id", F.length("text").alias("n"), F.substring("text", 1, 14).alias("head"))


@plan("scf08_item_count", "select page_id, (case when url in ('', 'None') then 0 else len(string_split(url, '/')) end)::bigint as n from pages")
def _(t):
    return t.pages.select("page_id", fx.count_items(F.col("url"), "/").alias("n"))


@plan("scf09_join_and_count", "with l as (select o_custkey, string_agg(o_orderkey::varchar, ';' order by o_orderkey) as items from orders group by 1) select o_custkey, items, len(string_split(items, ';'))::bigint as n from l")
def _(t):
    items = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ";")
    return t.orders.groupBy("o_custkey").agg(items.alias("items")).withColumn("n", F.size(F.split("items", ";")))


@plan("scf10_list_literal", "select p_partkey, p_brand as first, 2::bigint as n from part")
def _(t):
    parsed = readers.list_literal(F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']")))
    return t.part.select("p_partkey", parsed[0].alias("first"), F.size(parsed).alias("n"))


@plan("scf11_captures", r"select page_id, coalesce(try_cast(regexp_extract(url, 'page=([0-9,]+)', 1) as bigint), 0) as page from pages")
def _(t):
    found = F.replace(F.regexp_extract("url", r"page=([0-9,]+)", 1), F.lit(","), F.lit(""))
    return t.pages.select("page_id", F.coalesce(found.try_cast("long"), F.lit(0)).alias("page"))


@plan("scf12_numeric_text", "select page_id, regexp_matches(split_part(url, '/', -1), '^[0-9]+$') as numeric from pages")
def _(t):
    return t.pages.select("page_id", F.element_at(F.split("url", "/"), -1).rlike("^[0-9]+$").alias("numeric"))


@plan("scf13_file_stem", r"select page_id, regexp_extract(url, '([^/]*)$', 1) as stem from pages")
def _(t):
    return t.pages.select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("stem"))


@plan("scf14_clock", "select event_id, (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)))::bigint as s from events")
def _(t):
    return t.events.select("event_id", readers.clock_seconds(F.date_format("ts", "HH:mm:ss")).alias("s"))


@plan("scf15_epoch_ms", "select event_id, (floor(epoch(ts)) * 1000)::bigint as ms from events")
def _(t):
    return t.events.select("event_id", (F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000).alias("ms"))


@plan("scf16_window_ends", "select event_id, (floor(epoch(ts))::bigint // 5 * 5) as start, (floor(epoch(ts))::bigint // 5 * 5 + 5) as stop from events")
def _(t):
    start = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 5) * 5
    return t.events.select("event_id", start.alias("start"), (start + 5).alias("stop"))


@plan("scf17_roots", "select event_id, round(abs(value), 6) as a, round(sqrt(abs(value)), 6) as r, round(value * value, 4) as q from events")
def _(t):
    return t.events.select("event_id", F.abs("value").alias("a"), F.sqrt(F.abs("value")).alias("r"), F.round(F.col("value") * F.col("value"), 4).alias("q"))


@plan("scf18_logs", "select p_partkey, round(ln(p_retailprice), 6) as e, round(log10(p_retailprice), 6) as d, round(log2(p_retailprice), 6) as b from part")
def _(t):
    return t.part.select("p_partkey", F.ln("p_retailprice").alias("e"), F.log10("p_retailprice").alias("d"), F.log2("p_retailprice").alias("b"))


@plan("scf19_log1p", "select l_orderkey, l_linenumber::bigint as n, round(ln(1 + l_discount), 6) as a, round(exp(l_discount) - 1, 6) as b from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.log1p("l_discount").alias("a"), F.expm1("l_discount").alias("b"))


@plan("scf20_power", "select p_partkey, round(pow(p_size, 0.75::double), 6) as v from part")
def _(t):
    return t.part.select("p_partkey", F.pow("p_size", F.lit(0.75)).alias("v"))


@plan("scf21_sigmoid", "select vec_id, round(1 / (1 + exp(-embedding[1]::double)), 6) as p, round(ln((1 / (1 + exp(-embedding[1]::double))) / (1 - 1 / (1 + exp(-embedding[1]::double)))), 5) as x from embeddings")
def _(t):
    p = fx.sigmoid(F.col("embedding")[0].cast("double"))
    return t.embeddings.select("vec_id", p.alias("p"), F.round(fx.logit(p), 5).alias("x"))


@plan("scf22_half_even_bins", "select p_partkey, round_even(p_retailprice / 0.5, 0)::bigint as bin from part")
def _(t):
    return t.part.select("p_partkey", binned(F.col("p_retailprice"), 0.5).alias("bin"))


@plan("scf23_truncated_bins", "select p_partkey, floor(p_retailprice)::bigint as bin from part")
def _(t):
    return t.part.select("p_partkey", F.floor("p_retailprice").alias("bin"))


@plan("scf24_clip", "select c_custkey, round(least(greatest(c_acctbal, 0), 5000), 6) as v from customer")
def _(t):
    return t.customer.select("c_custkey", F.least(F.greatest("c_acctbal", F.lit(0.0)), F.lit(5000.0)).alias("v"))


@plan("scf25_elementwise", "select l_orderkey, l_linenumber::bigint as n, round(greatest(l_discount, l_tax), 6) as hi, round(least(l_discount, l_tax), 6) as lo from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), F.greatest("l_discount", "l_tax").alias("hi"), F.least("l_discount", "l_tax").alias("lo"))


@plan("scf26_safe_divide", "select l_orderkey, l_linenumber::bigint as n, round(case when l_tax > 0 then l_discount / l_tax else 0 end, 6) as v from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), fx.safe_divide(F.col("l_discount"), F.col("l_tax")).alias("v"))


@plan("scf27_ppm", "select a.p_partkey, round(coalesce(abs(a.p_retailprice - b.p_retailprice) / a.p_retailprice * 1e6, 50), 4) as ppm from part a left join part b on b.p_partkey = a.p_partkey + 1")
def _(t):
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_retailprice").alias("next"))
    return t.part.join(other, "p_partkey", "left").select("p_partkey", F.round(fx.ppm_error(F.col("p_retailprice"), F.col("next")), 4).alias("ppm"))


@plan("scf28_rate_ratio", "select user_id, round(log10((avg((abs(value) > 10)::int) + 1e-6) / (avg((abs(value) > 40)::int) + 1e-6)), 6) as b from events group by 1")
def _(t):
    share = lambda x: F.avg((F.abs("value") > x).cast("double"))
    return t.events.groupBy("user_id").agg(sig.rate_ratio(share(10), share(40)).alias("b"))


@plan("scf29_indicator_means", "select event_type, round(avg((value > 20)::int), 6) as a, round(avg((value > 50)::int), 6) as b from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(*[F.avg((F.col("value") > x).cast("double")).alias(n) for n, x in (("a", 20), ("b", 50))])


@plan("scf30_rounded_unique", "select p_size::bigint as p_size, len(list_distinct(list(round(p_retailprice, 1))))::bigint as n from part group by 1")
def _(t):
    return t.part.groupBy("p_size").agg(F.size(F.array_distinct(F.transform(F.collect_list("p_retailprice"), lambda x: F.round(x, 1)))).alias("n"))


@plan("scf31_storage_width", "with v as (select vec_id, unnest(embedding)::double as x from embeddings), h as (select vec_id, x, case when x = 0 then x else round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) end as s from v) select vec_id, round(sum(s), 6) as total, round(max(abs(s - x)) * 1e4, 6) as off from h group by 1")
def _(t):
    """Spark has no half-precision type: values are rounded to what it holds, and stored and computed on as doubles."""
    v = t.embeddings.select("vec_id", F.explode("embedding").alias("x")).withColumn("s", fx.half(F.col("x")))
    return v.groupBy("vec_id").agg(F.sum("s").alias("total"), (F.max(F.abs(F.col("s") - F.col("x").cast("double"))) * 1e4).alias("off"))


@plan("scf32_decibels", "select p_partkey, round(pow(10, p_size / 20.0::double), 6) as gain, round(10 * log10(p_retailprice), 6) as db from part")
def _(t):
    return t.part.select("p_partkey", fx.decibel_gain(F.col("p_size")).alias("gain"), (10 * F.log10("p_retailprice")).alias("db"))


@plan("scf33_grids", "select i::bigint as i, round(2 + 6 * i / 4.0::double, 6) as even, round(2 * pow(4, i / 4.0::double), 6) as ratio from (select unnest(range(0, 5)) as i)")
def _(t):
    grid = t.spark.range(1).select(F.arrays_zip(fx.spaced(2, 8, 5).alias("even"), fx.spaced(2, 8, 5, True).alias("ratio")).alias("z"))
    return grid.select(F.posexplode("z").alias("i", "z")).select("i", F.col("z")["even"].alias("even"), F.col("z")["ratio"].alias("ratio"))


@plan("scf34_array_chain", "select vec_id, round(list_sum(list_transform((list_sort(list_filter(embedding, lambda x: x > 0)))[1:5], lambda x: x::double * 2)), 6) as s from embeddings")
def _(t):
    chain = F.transform(F.slice(F.array_sort(F.filter("embedding", lambda x: x > 0)), 1, 5), lambda x: x.cast("double") * 2)
    return t.embeddings.select("vec_id", F.aggregate(chain, F.lit(0.0), lambda a, v: a + v).alias("s"))


@plan("scf35_padded_frames", "select vec_id, i::bigint as frame, round(list_sum(list_transform(embedding[(i * 24 + 1):(i * 24 + 24)], lambda x: x::double)), 6) as s from embeddings, (select unnest(range(0, 3)) as i)")
def _(t):
    frames = t.embeddings.select("vec_id", F.posexplode(sig.framed(F.transform("embedding", lambda x: x.cast("double")), 24)).alias("frame", "x"))
    return frames.select("vec_id", "frame", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"))


@plan("scf36_search_position", "select p_partkey, len(list_filter([5, 10, 20, 40], lambda e: e <= p_size))::bigint as at from part")
def _(t):
    return t.part.select("p_partkey", F.size(F.filter(F.array(*[F.lit(e) for e in (5, 10, 20, 40)]), lambda e: e <= F.col("p_size"))).alias("at"))


@plan("scf37_unique_inverse", "select p_partkey, dense_rank() over (order by p_brand)::bigint - 1 as code from part")
def _(t):
    codes = numbered(t.part.select("p_brand").distinct(), ["p_brand"], "code")
    return t.part.join(codes, "p_brand").select("p_partkey", "code")


@plan("scf38_running", "select event_id, round(sum(value) over w, 4) as total, round(value - lag(value) over w, 4) as diff from events window w as (partition by user_id order by event_id)")
def _(t):
    summed = running_before(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", "sum")
    rows = with_neighbours(summed, ["user_id"], ["event_id"], {"before": ("value", -1)})
    return rows.select("event_id", F.round(F.col("sum") + F.col("value"), 4).alias("total"), F.round(F.col("value") - F.col("before"), 4).alias("diff"))


@plan("scf39_arg_extremes", "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint as top, (list_position(embedding, list_min(embedding)) - 1)::bigint as low from embeddings")
def _(t):
    return t.embeddings.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("top"), (F.array_position("embedding", F.array_min("embedding")) - 1).alias("low"))


@plan("scf40_dot", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as sq from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.aggregate(F.zip_with("embedding", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, v: a + v).alias("sq"))


@plan("scf43_packed_bits", "select key, fp from fps", "fps")
def _(t):
    return fingerprints(t).select("key", F.col("fp")[0].alias("fp"))


@plan("scf44_popcount", "select key, bit_count(fp)::bigint as n, bit_count(fp & 255)::bigint as low from fps", "fps")
def _(t):
    return fingerprints(t).select("key", bits.popcount(F.col("fp")).alias("n"), bits.shared_bits(F.col("fp"), F.array(F.lit(255).cast("long"))).alias("low"))


@plan("scf45_hashes", "select doc_id, md5(text) as m, sha1(text) as s from documents")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha1("text").alias("s"))


@plan("scf46_clean_numbers", "select page_id, round(coalesce(try_cast(split_part(url, '/', -1) as double), 0), 6) as v from pages where not contains(lower(split_part(url, '/', -1)), 'nan')")
def _(t):
    last = F.element_at(F.split("url", "/"), -1)
    return t.pages.where(~F.lower(last).contains("nan")).select("page_id", fx.clean_number(last).alias("v"))


@plan("scf47_nan_ignored", "select event_type, round(max(case when value > 5 then value end), 6) as top, round(median(case when value > 5 then value end), 6) as mid from events group by 1")
def _(t):
    holes = t.events.withColumn("v", F.when(F.col("value") > 5, F.col("value")).otherwise(F.lit(float("nan"))))
    clean = F.nanvl("v", F.lit(None).cast("double"))
    middle = quantiles(holes.withColumn("c", clean), ["event_type"], "c", {"mid": 0.5})
    return holes.groupBy("event_type").agg(F.max(clean).alias("top")).join(middle, "event_type", "left").select("event_type", "top", "mid")


@plan("scf48_missing_key", "select doc_id, coalesce(quality, -1)::bigint as quality from documents left join labels using (doc_id)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@plan("scf49_routing", "select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'fast' when o_totalprice > 200000 then 'large' else 'plain' end as route from orders")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "fast").when(F.col("o_totalprice") > 200000, "large").otherwise("plain").alias("route"))


@plan("scf50_json_objects", "select event_id, coalesce((props->>'$.k')::bigint, -1) as k, json_valid(props) as ok from events")
def _(t):
    parsed = F.from_json("props", "k long")
    return t.events.select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"), parsed.isNotNull().alias("ok"))


@plan("scf51_membership", "select c_custkey, (c_mktsegment in ('BUILDING', 'MACHINERY')) as hit from customer")
def _(t):
    return t.customer.select("c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("hit"))


# Kernels. Formulas and graphs are made up from the part's numbers: the tables hold no chemistry.


def formulas(t):
    n = lambda k, m: (F.col("p_partkey") % k + m).cast("int").cast("string")
    return t.part.select("p_partkey", F.concat(F.lit("C"), n(7, 1), F.lit("H"), n(9, 2), F.lit("O"), n(3, 1)).alias("formula"))


def _once(fn, most=1000):
    """fn that keeps the results of the last `most` texts of a task."""
    kept: dict = {}

    def found(text):
        if text not in kept:
            if len(kept) >= most:
                kept.clear()
            kept[text] = fn(text)
        return kept[text]

    return found


def _mapped(df, fn, schema):
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for row in pdf.itertuples(index=False) for r in fn(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


@plan("udf01_canonical_key", "select doc_id, substr(md5(array_to_string(list_sort(string_split(lower(trim(text)), ' ')), ' ')), 1, 14) as key from documents where text is not null")
def _(t):
    """A key of the text in a normal form (words sorted), the stand-in for a canonical structure key; null stays null."""
    normal = F.array_join(F.array_sort(F.split(F.lower(F.trim("text")), " ")), " ")
    return t.documents.where("text is not null").select("doc_id", F.substring(F.md5(normal), 1, 14).alias("key"))


@plan("udf02_ngram_fingerprint", "with g as (select p_partkey, ('0x' || substr(md5(substr(p_type, i::int, 3)), 1, 4))::bigint % 60 as bit from part, (select unnest(range(1, 40)) as i) where i <= length(p_type) - 2) select p_partkey, sum(distinct 1::bigint << bit::int)::bigint as fp from g group by 1")
def _(t):
    """Bits of the hashed 3-grams of a text, the stand-in for a structure's fingerprint."""
    grams = F.transform(F.sequence(F.lit(1), F.length("p_type") - 2), lambda i: F.substring(F.md5(F.substr("p_type", i, F.lit(3))), 1, 4))
    places = F.array_distinct(F.transform(grams, lambda g: F.conv(g, 16, 10).cast("long") % 60))
    fp = F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a + F.pow(F.lit(2.0), p).cast("long"))
    return t.part.where(F.length("p_type") >= 3).select("p_partkey", fp.alias("fp"))


@plan("udf03_formula_mass", "with f as (select p_partkey, p_partkey % 7 + 1 as c, p_partkey % 9 + 2 as h, p_partkey % 3 + 1 as o from part) select p_partkey, round(12 * c + 1.00782503207::double * h + 15.99491461956::double * o, 6) as mass from f")
def _(t):
    return formulas(t).select("p_partkey", fx.formula_mass(F.col("formula")).alias("mass"))


@plan("udf04_subformulas")
def _(t):
    from ..functions.kernels import subformula_masses

    masses = _once(subformula_masses)
    return _mapped(rangejoin.spread(formulas(t)), lambda r: [(r.p_partkey, len(m := masses(r.formula)), m[-1] if m else None)], "p_partkey long, n long, heaviest double")


@plan("udf05_explained_by_formula")
def _(t):
    from ..functions.kernels import explained, subformula_masses

    peaks = [(20.0 + 7 * k, 1.0 + k) for k in range(6)]
    share = _once(lambda formula: explained(peaks, subformula_masses(formula), 2000.0))
    return _mapped(rangejoin.spread(formulas(t)), lambda r: [(r.p_partkey, share(r.formula))], "p_partkey long, share double")


@plan("udf06_fragments")
def _(t):
    from ..functions.kernels import fragments

    def cut(r):
        n = int(r.p_partkey % 5 + 3)
        return [(r.p_partkey, m) for m in fragments([12.0 + (k + r.p_partkey) % 3 for k in range(n)], [(k, k + 1) for k in range(n - 1)])]

    return _mapped(formulas(t), cut, "p_partkey long, mass double")


@plan("udf07_explained_intensity", "with p as (select rid, bin, sum(w) as w from peaks group by 1, 2), m as (select distinct (p_size * 4)::double as m from part), e as (select rid, bin, w, exists(select 1 from m where abs(m - bin) <= 1.5) as hit from p) select rid, round(sum(case when hit then w else 0 end) / sum(w), 6) as share from e group by 1", "peaks")
def _(t):
    p = peaks(t).groupBy("rid", "bin").agg(F.sum("w").alias("w"))
    masses = t.part.select((F.col("p_size") * 4).cast("double").alias("m")).distinct()
    hit = rangejoin.has_near(p.select(F.col("bin").cast("double").alias("b")).distinct(), "b", masses, "m", 1.5).withColumn("hit", F.lit(1))
    rows = p.join(hit, F.col("bin") == F.col("b"), "left")
    return rows.groupBy("rid").agg((F.sum(F.when(F.col("hit") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))


@plan("udf08_formula_text", "select p_partkey, 'C' || (p_partkey % 7 + 1) || 'H' || (p_partkey % 9 + 2) || 'O' || (p_partkey % 3 + 1) as formula from part")
def _(t):
    return formulas(t)


@plan("udf09_featuriser", "with f as (select rid, 'mz' as kind, bin, w from peaks union all select rid, 'loss', 200 - bin, w from peaks) select rid, kind, bin, round(sum(w), 6) as w from f group by 1, 2, 3", "peaks")
def _(t):
    both = F.array(F.struct(F.lit("mz").alias("kind"), F.col("bin").alias("bin")), F.struct(F.lit("loss").alias("kind"), (200 - F.col("bin")).alias("bin")))
    rows = peaks(t).select("rid", "w", F.explode(both).alias("f"))
    return rows.groupBy("rid", "f.kind", "f.bin").agg(F.sum("w").alias("w"))


@plan("udf10_audio_windows", "select vec_id, i::bigint as win, round(list_sum(list_transform(embedding[(i * 20 + 1):(i * 20 + 20)], lambda x: x::double)), 6) as s from embeddings, (select unnest(range(0, 4)) as i)")
def _(t):
    frames = t.embeddings.select("vec_id", F.posexplode(sig.framed(F.transform("embedding", lambda x: x.cast("double")), 20)).alias("win", "x"))
    return frames.select("vec_id", "win", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"))




def _taps():
    return [round(float(w), 12) for w in sig.resampling_filter(3, 2)]


@plan("udf10_resampled_chunks", f"with h as (select {_taps()}::double[] as h), x as (select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings), y as (select vec_id, list_transform(range(0, 96), lambda m: list_sum(list_transform(range(0, 64), lambda j: case when 2 * m + 30 - 3 * j between 0 and 60 then x[j + 1] * h[2 * m + 30 - 3 * j + 1] else 0 end))) as y from x, h), c as (select vec_id, 0::bigint as chunk, y[1:58] as s from y union all select vec_id, 1, y[39:96] from y) select vec_id, chunk, len(s)::bigint as n, round(list_sum(s), 6) as total, round(list_dot_product(s, s), 6) as energy from c")
def _(t):
    """A signal at 3/2 of its rate, in two chunks that overlap by a fifth of it."""
    chunks = sig.overlapping_chunks(t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")), "vec_id", "x", 64, 58)
    total = lambda f: F.aggregate("samples", F.lit(0.0), f)
    return chunks.select("vec_id", "chunk", F.size("samples").alias("n"), total(lambda a, v: a + v).alias("total"), total(lambda a, v: a + v * v).alias("energy"))


@plan("src10_decoded_audio", "with q as (select vec_id, list_transform(embedding[11:50], lambda x: round_even(least(greatest(x::double, -1), 1) * 32767, 0)) as q from embeddings) select vec_id, 8000::bigint as rate, 64::bigint as frames, 40::bigint as n, round(list_sum(q) / 32768, 5) as total from q")
def _(t):
    """Each vector as a WAV file, probed and read from its tenth frame on."""
    made = audio.encoded(t.embeddings.select("vec_id", sig.quantised(F.transform("embedding", lambda x: x.cast("double"))).alias("q")), "q", "file", 8000).select("vec_id", "file")
    probed = audio.probed(made, "file").select("vec_id", "frames")
    heard = audio.decoded(made, "file", 10 / 8000, 40 / 8000).join(probed, "vec_id")
    return heard.select("vec_id", "rate", "frames", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@plan("udf11_mix_at_snr", "with a as (select vec_id, list_transform(embedding[1:32], lambda x: x::double) as f, list_transform(embedding[33:64], lambda x: x::double) as b from embeddings), g as (select *, sqrt(list_dot_product(f, f) / 32) / (sqrt(list_dot_product(b, b) / 32) * pow(10, 6 / 20.0::double)) as g from a), m as (select vec_id, list_transform(range(1, 33), lambda i: f[i] + g * b[i]) as m from g), p as (select vec_id, m, greatest(list_max(list_transform(m, lambda x: abs(x))), 1) as p from m) select vec_id, list_sum(list_transform(m, lambda x: round_even(least(greatest(x / p, -1), 1) * 32767, 0)))::bigint as total from p")
def _(t):
    half = lambda i: F.transform(F.slice("embedding", i, 32), lambda x: x.cast("double"))
    mixed = t.embeddings.select("vec_id", sig.quantised(sig.mix_at_snr(half(1), half(33), F.lit(6.0))).alias("q"))
    return mixed.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@plan("udf12_log_mel")
def _(t):
    return sig.log_mel(t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("samples")), "vec_id", "samples", rate=8000, size=32, window=20, hop=16, bands=6, low=20.0, high=4000.0)
