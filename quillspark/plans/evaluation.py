"""Evaluation operators bound to the tables: text pairs, boxes of order lines, trees of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boxes as B
from ..operators import trees as R
from ..operators.evaluate import evaluate
from ..conf import EngineConf
from ..sources.tables import table

#: The accented letters of the tables; DuckDB's levenshtein counts bytes, so its texts get one byte for each.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 14 + len(ACCENTED) - 8)])
SPLIT = r"[\x09-\x0D\x1C-\x1F\x20]+"


def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as the reference, the next one as the hypothesis."""
    b = table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hypothesis"))
    return b.select("item_id", F.col("text").alias("reference")).join(nxt, "item_id")


def scored(unit: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        s = text_pairs(spark, d).withColumn("s", T.score(F.col("reference"), F.col("hypothesis"), unit))
        return s.select("item_id", "s.errors", "s.length", T.rate(F.col("s.errors"), F.col("s.length")).alias("rate"))

    return query


def text_grapheme_len(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.grapheme_count(F.col("text")).cast("bigint").alias("clusters"))


def text_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"))


def text_micro_avg(spark: SparkSession, d: str) -> DataFrame:
    s = text_pairs(spark, d).withColumn("s", T.score(F.col("reference"), F.col("hypothesis"), "word")).withColumn("bucket", F.length("reference") % 7)
    return T.micro_average(s, "s", ["bucket"]).select(F.col("bucket").cast("bigint").alias("bucket"), "errors", "length", "rate")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as boxes of a page: what is predicted, and a shifted truth that misses some lines."""
    l = table(spark, d, "lineitem").withColumn("idx", F.col("l_linenumber").cast("int"))
    box = lambda x, y, w, h: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(w).alias("w"), F.expr(h).alias("h"))
    p = l.select(F.col("l_orderkey").alias("page"), "idx", box("l_quantity", "l_linenumber * 6D", "20D + l_discount * 100D", "10D + l_tax * 100D").alias("box"))
    t = l.where("l_linestatus = 'O' or l_linenumber <> 2").select(F.col("l_orderkey").alias("page"), "idx", box("l_quantity + (l_linenumber % 3) * 3D", "l_linenumber * 6D + (l_linenumber % 2) * 2D", "22D + l_discount * 100D", "10D").alias("box"))
    return p, t


BOX_CTE = """
p as (select l_orderkey as page, l_linenumber::int as i, l_quantity as px, l_linenumber * 6.0::double as py, 20.0::double + l_discount * 100.0::double as pw, 10.0::double + l_tax * 100.0::double as ph from lineitem),
t as (select l_orderkey as page, l_linenumber::int as j, l_quantity + (l_linenumber % 3) * 3.0::double as tx, l_linenumber * 6.0::double + (l_linenumber % 2) * 2.0::double as ty, 22.0::double + l_discount * 100.0::double as tw, 10.0::double as th from lineitem where l_linestatus = 'O' or l_linenumber <> 2),
c0 as (select p.page, i, j, greatest(0, least(px + pw, tx + tw) - greatest(px, tx)) * greatest(0, least(py + ph, ty + th) - greatest(py, ty)) as common, pw * ph as a1, tw * th as a2 from p join t using (page)),
c as (select page, i, j, common / (a1 + a2 - common) as iou from c0 where common > 0)"""

MATCH_CTE = (
    BOX_CTE
    + """,
ranked as (select *, row_number() over (partition by page order by iou desc, i, j) as r from c),
walk(page, r, i, j, iou, took, is_, js) as (
  select page, 0::bigint, null::int, null::int, null::double, false, []::int[], []::int[] from (select distinct page from c)
  union all
  select k.page, k.r, k.i, k.j, k.iou, not (list_contains(w.is_, k.i) or list_contains(w.js, k.j)),
    case when list_contains(w.is_, k.i) or list_contains(w.js, k.j) then w.is_ else list_append(w.is_, k.i) end,
    case when list_contains(w.is_, k.i) or list_contains(w.js, k.j) then w.js else list_append(w.js, k.j) end
  from walk w join ranked k on k.page = w.page and k.r = w.r + 1),
m as (select page, i, j, iou from walk where took),
sizes as (select page, sum(a)::bigint as predicted, sum(b)::bigint as truth from (select page, 1 as a, 0 as b from p union all select page, 0, 1 from t) group by page),
rep as (select page, predicted, truth, count(m.i)::bigint as matched, count(*) filter (where iou >= 0.5)::bigint as tp, round(coalesce(sum(iou), 0), 6) as iou_sum from sizes left join m using (page) group by all)"""
)


def box_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    return B.candidates(p, t, "page").select("page", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("iou", 9).alias("iou"))


def box_greedy_match(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    return B.match(p, t, "page").select("page", F.inline("matches")).select("page", "i", "j", F.round("iou", 9).alias("iou"))


def box_scores(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    r = B.rates(B.report(p, t, "page"))
    return r.select("page", "predicted", "truth", "matched", "tp", "fp", "fn", F.round("iou_sum", 6).alias("iou_sum"), *(F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")))


def box_micro_avg(spark: SparkSession, d: str) -> DataFrame:
    p, t = _sides(spark, d)
    reports = B.report(p, t, "page").withColumn("bucket", F.col("page") % 10)
    r = B.rates(B.aggregate(reports, ["bucket"]))
    return r.select("bucket", "predicted", "truth", "matched", "tp", "fp", "fn", *(F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")))


def box_means(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from corners in any order, checked; both mean overlaps of a page."""
    def turned(df: DataFrame) -> DataFrame:
        b = F.col("box")
        return df.withColumn("box", B.checked(B.from_corners(b.x + b.w, b.y, b.x, b.y + b.h)))

    p, t = _sides(spark, d)
    return B.rates(B.report(turned(p), turned(t), "page")).select("page", "matched", F.round("mean_iou", 6).alias("mean_iou"), F.round("mean_matched_iou", 6).alias("mean_matched_iou"))


# trees ---------------------------------------------------------------------------------------


def order_trees(spark: SparkSession, d: str) -> DataFrame:
    """order_id, tree: an order as the root, its lines in order as leaves with text and a box."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    leaf = F.struct(
        F.concat("l_returnflag", "l_linestatus").alias("type"), F.concat_ws(" ", F.lit("part"), F.col("l_partkey"), F.lit("of"), F.col("l_suppkey")).alias("text"),
        F.array(F.col("l_quantity"), F.col("l_linenumber") * 6.0, 20.0 + F.col("l_discount") * 100.0, F.lit(5.0)).alias("bbox"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"),
    )
    lines = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", leaf.alias("leaf")))).alias("ls"))
    got = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    empty = F.array().cast(lines.schema["ls"].dataType)
    return got.select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderpriority", F.coalesce("ls", empty).alias("ls"))


def as_tree(label: str, leaves: str):
    kept = F.transform(F.expr(leaves), lambda x: F.struct(x.leaf.type.alias("type"), x.leaf.text.alias("text"), x.leaf.bbox.alias("bbox")))
    return F.to_json(F.struct(F.col(label).alias("type"), kept.alias("children")))


def customer_trees(spark: SparkSession, d: str) -> DataFrame:
    """cust_id, tree: a customer, its orders by key, and their lines."""
    o = order_trees(spark, d)
    sub = F.struct(F.col("o_orderpriority").alias("type"), F.transform("ls", lambda x: F.struct(x.leaf.type.alias("type"))).alias("children"))
    orders = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("order_id", sub.alias("t")))).alias("os"))
    c = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    none = F.array().cast(orders.schema["os"].dataType)
    return c.select(F.col("c_custkey").alias("cust_id"), F.to_json(F.struct(F.col("c_mktsegment").alias("type"), F.transform(F.coalesce("os", none), lambda x: x.t).alias("children"))).alias("tree"))


def tree_features(spark: SparkSession, d: str) -> DataFrame:
    f = customer_trees(spark, d).select("cust_id", R.tree_features(F.col("tree")).alias("f"))
    return f.select("cust_id", *(F.col(f"f.{n}").cast("bigint").alias(n) for n in ("size", "leaves", "depth", "weight")))


def _next(trees: DataFrame, key: str) -> DataFrame:
    other = trees.select((F.col(key) - 1).alias(key), F.col("tree").alias("other"))
    return trees.select(key, "tree").join(other, key)


def ted_star(spark: SparkSession, d: str) -> DataFrame:
    """Orders against the order with the next key: one root each, lines as leaves."""
    t = order_trees(spark, d).select("order_id", as_tree("o_orderpriority", "ls").alias("tree"))
    return R.spread(_next(t, "order_id")).select("order_id", R.tree_distance(F.col("tree"), F.col("other")).cast("bigint").alias("distance"))


def ted_path(spark: SparkSession, d: str) -> DataFrame:
    """The same lines as a path, each the only child of the one before: a string's edit distance."""
    o = order_trees(spark, d).select("order_id", F.transform("ls", lambda x: x.leaf.type).alias("codes")).where("size(codes) > 0")
    chain = F.concat(F.array_join(F.transform("codes", lambda c: F.concat(F.lit('{"type":"'), c, F.lit('","children":['))), ""), F.expr("repeat(']}', size(codes))"))
    return _next(o.select("order_id", chain.alias("tree")), "order_id").select("order_id", R.tree_distance(F.col("tree"), F.col("other")).cast("bigint").alias("distance"))


def _weighed(spark: SparkSession, d: str, with_distance: bool) -> DataFrame:
    conf = EngineConf()
    return R.compared(_next(customer_trees(spark, d), "cust_id"), "tree", "other", conf.max_nodes, conf.max_ted_work, with_distance=with_distance)


def eval_admission(spark: SparkSession, d: str) -> DataFrame:
    return _weighed(spark, d, False).select("cust_id", (F.col("fa.weight") * F.col("fb.weight")).alias("work"), "verdict")


def ted_general(spark: SparkSession, d: str) -> DataFrame:
    """Customer trees against the next, where the cost check admits them."""
    s = _weighed(spark, d, True).select("cust_id", F.col("distance").cast("bigint").alias("distance"), F.col("fa.size").cast("bigint").alias("truth_nodes"), F.col("fb.size").cast("bigint").alias("predicted_nodes"), "verdict")
    return s.withColumn("normalised", R.normalised(F.col("distance"), F.col("truth_nodes"), F.col("predicted_nodes")))


def tree_micro_avg(spark: SparkSession, d: str) -> DataFrame:
    t = order_trees(spark, d).select("order_id", as_tree("o_orderpriority", "ls").alias("tree"), (F.size("ls") + 1).alias("n"))
    other = t.select((F.col("order_id") - 1).alias("order_id"), F.col("tree").alias("other"), F.col("n").alias("m"))
    s = t.join(other, "order_id").select((F.col("order_id") % 10).alias("bucket"), R.tree_distance(F.col("tree"), F.col("other")).alias("distance"), F.col("n").alias("truth_nodes"), F.col("m").alias("predicted_nodes"))
    return R.aggregate(s, ["bucket"]).select("bucket", "distance", "truth_nodes", "predicted_nodes", F.round("normalised", 9).alias("normalised"))


def evaluate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every order as a document; what is predicted lacks some lines, mislabels and misreads others."""
    o = order_trees(spark, d)
    truth = o.select("order_id", as_tree("o_orderpriority", "ls").alias("tree"))
    seen = F.transform(F.filter("ls", lambda x: x.leaf.n % 5 != 4), lambda x: F.struct(F.struct(
        F.when(x.leaf.flag == "R", F.lit("XX")).otherwise(x.leaf.type).alias("type"), F.when(x.leaf.n % 3 == 0, F.regexp_replace(x.leaf.text, "of", "0f")).otherwise(x.leaf.text).alias("text"),
        F.when(x.leaf.n % 2 == 0, F.array(x.leaf.bbox[0] + 8.0, x.leaf.bbox[1] + 2.0, x.leaf.bbox[2], x.leaf.bbox[3])).otherwise(x.leaf.bbox).alias("bbox")).alias("leaf")))
    predicted = o.withColumn("seen", seen).select("order_id", as_tree("o_orderpriority", "seen").alias("tree"))
    out = evaluate(predicted, truth, "order_id", unit="codepoint")
    return out.select("order_id", "verdict", "cer_errors", "cer_length", "wer_errors", "wer_length", "tp", "fp", "fn", "matched", F.round("f1", 6).alias("f1"), "ted", "ted_work")


QUERIES = {
    "text_cer_codepoint": scored("codepoint"), "text_cer_grapheme": scored("grapheme"), "text_wer": scored("word"), "text_grapheme_len": text_grapheme_len, "text_words": text_words, "text_micro_avg": text_micro_avg,
    "box_iou_pairs": box_iou_pairs, "box_greedy_match": box_greedy_match, "box_scores": box_scores, "box_micro_avg": box_micro_avg, "box_means": box_means,
    "tree_features": tree_features, "ted_star": ted_star, "ted_path": ted_path, "ted_general": ted_general, "tree_micro_avg": tree_micro_avg, "eval_admission": eval_admission, "evaluate_documents": evaluate_documents,
}

_PAIRS = f"pairs as (select a.item_id, translate(a.text, '{ACCENTED}', {ONE_BYTE}) as r, translate(b.text, '{ACCENTED}', {ONE_BYTE}) as h from benchmark a join benchmark b on b.item_id = a.item_id + 1)"
_CHARS = f"with {_PAIRS} select item_id, levenshtein(r, h)::bigint as errors, length(r)::bigint as length, case when length(r) = 0 then case when levenshtein(r, h) = 0 then 0 else 'inf'::double end else levenshtein(r, h)::double / length(r) end as rate from pairs"
_WORDS = f"""with w as (select a.item_id, length(a.text) % 7 as bucket, list_filter(regexp_split_to_array(a.text, '{SPLIT}'), lambda x: x <> '') as r, list_filter(regexp_split_to_array(b.text, '{SPLIT}'), lambda x: x <> '') as h from benchmark a join benchmark b on b.item_id = a.item_id + 1),
e as (select *, list_distinct(list_concat(r, h)) as k from w),
s as (select item_id, bucket, levenshtein(array_to_string(list_transform(r, lambda x: chr(list_position(k, x)::int)), ''), array_to_string(list_transform(h, lambda x: chr(list_position(k, x)::int)), ''))::bigint as errors, len(r)::bigint as length from e)"""
_STARS = """codes as (select o_orderkey as id, o_orderpriority as root, coalesce((select string_agg(case l_returnflag || l_linestatus when 'AF' then 'a' when 'NF' then 'b' when 'NO' then 'c' when 'RF' then 'd' when 'AO' then 'e' when 'RO' then 'f' end, '' order by l_linenumber, l_returnflag || l_linestatus) from lineitem where l_orderkey = o_orderkey), '') as s from orders)"""
_TREE = """n as (select c_custkey as id, count(distinct o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by 1),
k as (select o_custkey as id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r, (select count(*) from lineitem where l_orderkey = o_orderkey) as items from orders),
f as (select n.id, 1 + n.orders + coalesce(sum(items), 0) as size, greatest(1, coalesce(sum(greatest(1, items)), 1)) as leaves,
  case when n.orders = 0 then 1 when max(items) = 0 then 2 else 3 end as depth,
  1 + n.orders + coalesce(sum(items), 0) + coalesce(sum(case when r > 1 then 1 + items else 0 end), 0) + coalesce(sum(greatest(items - 1, 0)), 0) as weight
  from n left join k using (id) group by n.id, n.orders)"""

ORACLES = {
    "text_cer_codepoint": _CHARS,
    "text_cer_grapheme": _CHARS,
    "text_wer": _WORDS + " select item_id, errors, length, case when length = 0 then case when errors = 0 then 0 else 'inf'::double end else errors::double / length end as rate from s",
    "text_micro_avg": _WORDS + " select bucket::bigint as bucket, sum(errors)::bigint as errors, sum(length)::bigint as length, sum(errors)::double / sum(length) as rate from s group by bucket",
    "text_grapheme_len": "select doc_id, length_grapheme(text)::bigint as clusters from documents",
    "text_words": f"select doc_id, len(list_filter(regexp_split_to_array(text, '[\\x09-\\x0D\\x1C-\\x1F\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> ''))::bigint as n_words from documents",
    "box_iou_pairs": f"with {BOX_CTE} select page, i, j, round(iou, 9) as iou from c",
    "box_greedy_match": f"with recursive {MATCH_CTE} select page, i, j, round(iou, 9) as iou from m",
    "box_scores": f"with recursive {MATCH_CTE} select page, predicted, truth, matched, tp, predicted - tp as fp, truth - tp as fn, iou_sum, round(case when predicted = 0 then 1 else tp::double / predicted end, 6) as precision, round(case when truth = 0 then 1 else tp::double / truth end, 6) as recall, round(case when (case when predicted = 0 then 1 else tp::double / predicted end) + (case when truth = 0 then 1 else tp::double / truth end) = 0 then 0 else 2 * (case when predicted = 0 then 1 else tp::double / predicted end) * (case when truth = 0 then 1 else tp::double / truth end) / ((case when predicted = 0 then 1 else tp::double / predicted end) + (case when truth = 0 then 1 else tp::double / truth end)) end, 6) as f1 from rep",
    "box_means": f"with recursive {MATCH_CTE} select page, matched, round(case when truth = 0 then case when iou_sum = 0 then 0 else 'inf'::double end else iou_sum / truth end, 6) as mean_iou, round(case when matched = 0 then 0 else iou_sum / matched end, 6) as mean_matched_iou from rep".replace("round(coalesce(sum(iou), 0), 6) as iou_sum", "coalesce(sum(iou), 0) as iou_sum"),
    "box_micro_avg": f"with recursive {MATCH_CTE}, g as (select page % 10 as bucket, sum(predicted)::bigint as predicted, sum(truth)::bigint as truth, sum(matched)::bigint as matched, sum(tp)::bigint as tp from rep group by 1) select bucket, predicted, truth, matched, tp, predicted - tp as fp, truth - tp as fn, round(tp::double / predicted, 6) as precision, round(tp::double / truth, 6) as recall, round(2 * (tp::double / predicted) * (tp::double / truth) / (tp::double / predicted + tp::double / truth), 6) as f1 from g",
    "tree_features": f"with {_TREE} select id as cust_id, size::bigint as size, leaves::bigint as leaves, depth::bigint as depth, weight::bigint as weight from f",
    "ted_star": f"with {_STARS} select a.id as order_id, (levenshtein(a.s, b.s) + case when a.root = b.root then 0 else 1 end)::bigint as distance from codes a join codes b on b.id = a.id + 1",
    "ted_path": f"with {_STARS} select a.id as order_id, levenshtein(a.s, b.s)::bigint as distance from codes a join codes b on b.id = a.id + 1 where a.s <> '' and b.s <> ''",
    "tree_micro_avg": f"with {_STARS} select a.id % 10 as bucket, sum(levenshtein(a.s, b.s) + case when a.root = b.root then 0 else 1 end)::bigint as distance, sum(length(a.s) + 1)::bigint as truth_nodes, sum(length(b.s) + 1)::bigint as predicted_nodes, round(sum(levenshtein(a.s, b.s) + case when a.root = b.root then 0 else 1 end)::double / greatest(sum(length(a.s) + 1), sum(length(b.s) + 1)), 9) as normalised from codes a join codes b on b.id = a.id + 1 group by 1",
    "eval_admission": f"with {_TREE} select a.id as cust_id, (a.weight * b.weight)::bigint as work, case when greatest(a.size, b.size) > 2000 then 'too_many_nodes' when a.weight * b.weight > 180000 then 'too_much_work' else 'admitted' end as verdict from f a join f b on b.id = a.id + 1",
}
