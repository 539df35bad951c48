"""Record-linkage queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.geometry import EARTH_RADIUS_M
from ..operators import fuzzy, linkage, spatial
from .registry import query, r, rounded, table


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_totalprice").alias("balance")
    )


def _customers(spark, sf):
    """One segment has other keys, so that rows of both sides stay unmatched."""
    key = F.when(F.col("c_mktsegment") == "HOUSEHOLD", -F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    return table(spark, sf, "customer").select(key.alias("custkey"), F.col("c_acctbal").alias("balance"), "c_mktsegment")


_SIDES = """l as (select o_custkey custkey, o_orderkey, o_totalprice balance from orders),
r as (select case when c_mktsegment = 'HOUSEHOLD' then -c_custkey - 1 else c_custkey end custkey, c_acctbal balance, c_mktsegment from customer)"""


def _link_sql(kind: str) -> str:
    key = "coalesce(l.custkey, r.custkey)" if kind == "full" else "l.custkey"
    return f"with {_SIDES} select {key} custkey, o_orderkey, l.balance, r.balance balance_right, c_mktsegment from l {kind} join r on l.custkey = r.custkey"


@query("link_exact_left", _link_sql("left"))
def link_exact_left(spark, sf):
    return linkage.exact_match(_orders(spark, sf), _customers(spark, sf), "custkey", "left", validate_merge="many_to_one")[0]


@query("link_exact_inner", _link_sql("inner"))
def link_exact_inner(spark, sf):
    return linkage.exact_match(_orders(spark, sf), _customers(spark, sf), "custkey", "inner")[0]


@query("link_exact_outer", _link_sql("full"))
def link_exact_outer(spark, sf):
    return linkage.exact_match(_orders(spark, sf), _customers(spark, sf), "custkey", "outer")[0]


@query("link_skewed_right", f"with {_SIDES} select r.custkey, r.balance, o_orderkey, l.balance balance_right, c_mktsegment from r left join l on l.custkey = r.custkey")
def link_skewed_right(spark, sf):
    """One-to-many left link written for a hot key on the many side."""
    linked, _ = linkage.exact_match(_customers(spark, sf), _orders(spark, sf), "custkey", "left", skewed_right=True)
    return linked




def _summary_sql(how: str, rows: str) -> str:
    return f"""select '{how}' source, (select count(*) from r) n_source, count(r.custkey) n_matched, count(*) - count(r.custkey) n_unmatched,
      {r('count(r.custkey) / (count(*) * 1.0)', 'match_rate')}, 'exact' match_type, 'custkey' key_columns, ({rows}) n_rows from l left join r on l.custkey = r.custkey"""


@query(
    "linkage_summary",
    f"with {_SIDES} "
    + " union all ".join(
        _summary_sql(how, f"select count(*) from l {kind} join r on l.custkey = r.custkey")
        for how, kind in (("left", "left"), ("inner", "inner"), ("outer", "full"))
    ),
)
def linkage_summary(spark, sf):
    """Each customer key is unique, so joined rows are matched left rows."""
    left, right = _orders(spark, sf), _customers(spark, sf)
    rows = [linkage.link_summary(left, right, ["custkey"], how, source=how) for how in ("left", "inner", "outer")]
    return rounded(linkage.linkage_table(rows))


@query(
    "linkage_summary_multiplied",
    f"""with {_SIDES} select 'orders' source, (select count(*) from l) n_source, count(*) filter (where custkey in (select custkey from l)) n_matched,
      count(*) filter (where custkey not in (select custkey from l)) n_unmatched,
      {r('count(*) filter (where custkey in (select custkey from l)) / (count(*) * 1.0)', 'match_rate')}, 'exact' match_type, 'custkey' key_columns,
      (select count(*) from r left join l on r.custkey = l.custkey) n_rows from r""",
)
def linkage_summary_multiplied(spark, sf):
    """Repeated right keys multiply rows but not matches."""
    return rounded(linkage.link_summary(_customers(spark, sf), _orders(spark, sf), ["custkey"], "left", source="orders"))


@query(
    "link_multi",
    """select l_orderkey orderkey, l_suppkey suppkey, l_linenumber, l_quantity, o_custkey, s_name from lineitem
left join orders on l_orderkey = o_orderkey left join supplier on l_suppkey = case when s_acctbal < 0 then -s_suppkey - 1 else s_suppkey end""",
)
def link_multi(spark, sf):
    linked, _ = linkage.link_sources(*_multi(spark, sf))
    return linked


def _multi(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("suppkey"), "l_linenumber", "l_quantity"
    )
    sources = {
        "orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey"),
        "supplier": table(spark, sf, "supplier").select(
            F.when(F.col("s_acctbal") < 0, -F.col("s_suppkey") - 1).otherwise(F.col("s_suppkey")).alias("suppkey"), "s_name"
        ),
        "region": table(spark, sf, "region"),
    }
    return lines, sources, ["orderkey", "suppkey"]


@query(
    "link_multi_summary",
    f"""select 'orders' source, (select count(*) from orders) n_source, count(o_orderkey) n_matched, count(*) - count(o_orderkey) n_unmatched,
 {r('count(o_orderkey) / (count(*) * 1.0)', 'match_rate')}, 'exact' match_type, 'orderkey' key_columns, count(*) n_rows from lineitem left join orders on l_orderkey = o_orderkey
union all select 'supplier', (select count(*) from supplier), count(s_suppkey), count(*) - count(s_suppkey),
 {r('count(s_suppkey) / (count(*) * 1.0)', 'x')}, 'exact', 'suppkey', count(*) from lineitem left join supplier on l_suppkey = case when s_acctbal < 0 then -s_suppkey - 1 else s_suppkey end""",
)
def link_multi_summary(spark, sf):
    return rounded(linkage.link_sources(*_multi(spark, sf))[1])


@query("link_pass_through", "select c_custkey id, c_acctbal, 'primary' source_file, 'direct' link_status from customer")
def link_pass_through(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return linkage.link_sources(customers, {})[0]


@query(
    "match_rate",
    f"""select count(quality) matched, count(*) - count(quality) unmatched, count(*) total, {r('count(quality) / (count(*) * 1.0)', 'rate')}
from documents left join labels on documents.doc_id = labels.doc_id""",
)
def match_rate(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(linkage.calculate_match_rate(docs, "doc_id", "quality"))


def _garbled(spark, sf):
    text = F.replace(F.replace("p_name", F.lit("e"), F.lit("3")), F.lit("o"), F.lit("0"))
    return table(spark, sf, "part").select("p_partkey", "p_brand", text.alias("garbled"))


def _names(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n_parts"))


_NAMES = """g as (select p_partkey, p_brand, replace(replace(p_name, 'e', '3'), 'o', '0') garbled from part),
ln as (select distinct garbled l from g), rn as (select p_name r, count(*) n_parts from part group by 1)"""
_SIM = "1 - levenshtein(lower(l), lower(r)) / (greatest(length(l), length(r)) * 1.0)"


@query(
    "link_levenshtein",
    f"""with {_NAMES}, sc as (select l, r, n_parts, {_SIM} s from ln, rn where {_SIM} >= 0.8),
be as (select *, row_number() over (partition by l order by round(s, 9) desc, r) k from sc)
select p_partkey, garbled, r match_value, {r('s', 'match_score')}, r p_name, n_parts from g left join be on garbled = l and k = 1""",
)
def link_levenshtein(spark, sf):
    linked, _ = fuzzy.fuzzy_match(_garbled(spark, sf), _names(spark, sf), "garbled", "p_name", 0.8)
    return rounded(linked.drop("p_brand"))


@query(
    "link_levenshtein_summary",
    f"""with {_NAMES}, ma as (select distinct l from ln, rn where {_SIM} >= 0.8)
select 'names' source, (select count(*) from rn) n_source, count(l) n_matched, count(*) - count(l) n_unmatched, {r('count(l) / (count(*) * 1.0)', 'match_rate')},
 'fuzzy_levenshtein' match_type, 'garbled,p_name' key_columns, count(*) n_rows from g left join ma on garbled = l""",
)
def link_levenshtein_summary(spark, sf):
    _, summary = fuzzy.fuzzy_match(_garbled(spark, sf), _names(spark, sf), "garbled", "p_name", 0.8, source="names")
    return rounded(summary)


@query(
    "link_blocked",
    f"""with {_NAMES}, bl as (select distinct p_brand, garbled l from g), br as (select distinct p_brand, p_name r from part),
sc as (select bl.p_brand, l, r, {_SIM} s from bl join br on bl.p_brand = br.p_brand where {_SIM} >= 0.85),
be as (select *, row_number() over (partition by p_brand, l order by round(s, 9) desc, r) k from sc)
select p_brand, l left_value, r match_value, {r('s', 'match_score')} from be where k = 1""",
)
def link_blocked(spark, sf):
    right = table(spark, sf, "part").select("p_brand", "p_name")
    pairs = fuzzy.best_matches(_garbled(spark, sf), right, "garbled", "p_name", fuzzy.BLOCKED_THRESHOLD, block_on=["p_brand"])
    return rounded(pairs)


@query(
    "link_contains",
    """with w as (select distinct substr(p_name, strpos(p_name, ' ') + 1) l from part), rn as (select distinct p_name r from part)
select l left_value, min(r) match_value, cast(1.0 as double) match_score from w, rn where contains(lower(r), lower(l)) group by l""",
)
def link_contains(spark, sf):
    part = table(spark, sf, "part")
    words = part.select(F.expr("substr(p_name, instr(p_name, ' ') + 1)").alias("word"))
    return fuzzy.best_matches(words, part, "word", "p_name", method="contains")


@query(
    "link_equal",
    """select distinct garbled left_value, garbled match_value, cast(1.0 as double) match_score
from (select replace(replace(p_name, 'e', '3'), 'o', '0') garbled from part) where garbled in (select p_name from part)""",
)
def link_equal(spark, sf):
    part = table(spark, sf, "part")
    return fuzzy.best_matches(_garbled(spark, sf), part, "garbled", "p_name", method="equal")


#: Jaro-Winkler step by step: each left character takes the first free equal
#: right character in reach; taken right characters are overwritten.
_JARO_STEPS = """st as (select l, r, a, b, reach, 0 i, b rest, '' taken from pa
 union all
 select l, r, a, b, reach, i + 1, case when p > 0 then substr(rest, 1, lo + p - 2) || chr(1) || substr(rest, lo + p) else rest end, taken || case when p > 0 then c else '' end
 from (select *, strpos(substr(rest, lo, i + reach + 2 - lo), c) p from
   (select *, substr(a, i + 1, 1) c, greatest(1, i + 1 - reach) lo from st where i < length(a)))),
fin as (select l, r, a, b, length(taken) m, taken,
  array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda k: substr(rest, k, 1) = chr(1)), lambda k: substr(b, k, 1)), '') other from st where i = length(a)),
ja as (select l, r, a, b, case when a = b then 1.0 when m = 0 then 0.0 else (m / (length(a) * 1.0) + m / (length(b) * 1.0)
  + (m - len(list_filter(range(1, m + 1), lambda k: substr(taken, k, 1) <> substr(other, k, 1))) / 2.0) / m) / 3 end j from fin),
sc as (select l, r, j + 0.1 * (case when a[1:4] = b[1:4] and length(a) >= 4 and length(b) >= 4 then 4 when a[1:3] = b[1:3] and length(a) >= 3 then 3
  when a[1:2] = b[1:2] and length(a) >= 2 then 2 when a[1:1] = b[1:1] then 1 else 0 end) * (1 - j) s from ja)"""
_JARO_PAIR = "l, r, lower(l) a, lower(r) b, greatest(greatest(length(l), length(r)) // 2 - 1, 0) reach"
_JARO = f"""with recursive {_NAMES}, pa as (select {_JARO_PAIR} from ln, rn), {_JARO_STEPS},
be as (select *, row_number() over (partition by l order by round(s, 9) desc, r) k from sc where s >= 0.8)
select p_partkey, garbled, be.r match_value, {r('s', 'match_score')}, be.r p_name, n_parts from g left join be on garbled = l and k = 1 left join rn on be.r = rn.r"""


@query("link_jaro_winkler", _JARO)
def link_jaro_winkler(spark, sf):
    linked, _ = fuzzy.fuzzy_match(_garbled(spark, sf), _names(spark, sf), "garbled", "p_name", 0.8, "jaro_winkler")
    return rounded(linked.drop("p_brand"))


#: Names of 18 characters reach 0.985 only with all characters in common: with
#: one missing the score is at most 0.4 + 0.6 * (2 * 17/18 + 1) / 3 < 0.978.
_TYPED = "replace(c_name, 'r#', '#r')"


@query(
    "link_jaro_winkler_names",
    f"""with recursive c as (select c_custkey, {_TYPED} l, c_name r, list_sort(string_split(lower(c_name), '')) chars from customer),
pa as (select {_JARO_PAIR.replace("l, r,", "x.l, y.r,", 1).replace("(l)", "(x.l)").replace("(r)", "(y.r)")} from c x join c y on x.chars = y.chars), {_JARO_STEPS},
be as (select *, row_number() over (partition by l order by round(s, 9) desc, r) k from sc where s >= 0.985)
select c_custkey, c.l typed, be.r match_value, {r('s', 'match_score')} from c left join be on c.l = be.l and k = 1""",
)
def link_jaro_winkler_names(spark, sf):
    """Customer names with two characters swapped, against all names."""
    customers = table(spark, sf, "customer")
    typed = customers.select("c_custkey", F.replace("c_name", F.lit("r#"), F.lit("#r")).alias("typed"))
    linked, _ = fuzzy.fuzzy_match(typed, customers.select("c_name"), "typed", "c_name", 0.985, "jaro_winkler")
    return rounded(linked.drop("c_name"))


def _placed(df, key):
    lat = (F.col(key) * 618034 % 1000000) / 1000000.0 * 120 - 60
    lon = (F.col(key) * 414214 % 1000000) / 1000000.0 * 360 - 180
    return df.select(key, lat.alias("latitude"), lon.alias("longitude"))


def _placed_sql(source: str, key: str, p: str) -> str:
    return f"select {key} {p}k, ({key} * 618034 % 1000000) / 1000000.0 * 120 - 60 {p}lat, ({key} * 414214 % 1000000) / 1000000.0 * 360 - 180 {p}lon from {source}"


_HAVERSINE = (
    f"{2 * EARTH_RADIUS_M} * asin(sqrt(least(1.0, pow(sin(radians(rlat - llat) / 2), 2)"
    " + cos(radians(llat)) * cos(radians(rlat)) * pow(sin(radians(rlon - llon) / 2), 2))))"
)


@query(
    "link_nearest",
    f"""with l as ({_placed_sql('customer', 'c_custkey', 'l')}), r as ({_placed_sql('supplier', 's_suppkey', 'r')}),
d as (select lk, rk, {_HAVERSINE} d from l, r), b as (select *, row_number() over (partition by lk order by d, rk) k from d where d <= 500000)
select l.lk c_custkey, rk match_key, {r('d', 'distance_m', 3)} from l left join b on l.lk = b.lk and k = 1""",
)
def link_nearest(spark, sf):
    left, right = _placed(table(spark, sf, "customer"), "c_custkey"), _placed(table(spark, sf, "supplier"), "s_suppkey")
    linked, _ = spatial.link_with_spatial(left, right, "c_custkey", "s_suppkey", 500000.0)
    return rounded(linked.select("c_custkey", "match_key", "distance_m"), 3)


