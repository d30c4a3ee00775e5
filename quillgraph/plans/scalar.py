"""Scalar functions: text, dates, numbers, hashes, arrays, JSON, conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from . import surrogates as S

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = S.sql(oracle)
        return f

    return keep


def _docs(s, d):
    return S.raw(s, d, "documents")


def _events(s, d):
    return S.raw(s, d, "events")


WORDY = r"[\p{L}\p{N}_]+"


@register("str1_normalize_text", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents")
def str1(s, d):
    return _docs(s, d).select("doc_id", T.normalize_lines("text").alias("text"))


@register("str2_token_count", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{T.TOKEN}')) AS BIGINT) AS n FROM documents")
def str2(s, d):
    return _docs(s, d).select("doc_id", T.token_count("text").alias("n"))


@register("str4_doc_references", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(upper(text || ' xx ' || doc_id % 1000 || '/20' || (10 + doc_id % 10) || '/tt-btc y ' || doc_id % 7 || '/2019/qh14'), '\b\d{1,4}/\d{4}/[A-Z0-9\-]+\b'))) AS refs FROM documents")
def str4(s, d):
    """Whole texts, with two numbers put behind each."""
    k = F.col("doc_id")
    text = F.concat("text", F.lit(" xx "), (k % 1000).cast("string"), F.lit("/20"), (10 + k % 10).cast("string"), F.lit("/tt-btc y "), (k % 7).cast("string"), F.lit("/2019/qh14"))
    return S.raw(s, d, "documents").select("doc_id", T.doc_references(text).alias("refs"))


@register("str5_safe_id", "SELECT DISTINCT url, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'doc') AS safe FROM pages")
def str5(s, d):
    return S.raw(s, d, "pages").select("url", T.safe_id("url").alias("safe")).distinct()


@register("str6_chunk_uid", "SELECT doc_id, chunk_order, doc_id || '__' || printf('%05d', chunk_order) AS uid FROM chk")
def str6(s, d):
    return S.chunks(s, d).select("doc_id", "chunk_order", T.chunk_uid("doc_id", "chunk_order").alias("uid"))


@register("str7_generated_id", "SELECT doc_id, lower(trim(substr(regexp_replace(b, '[^A-Za-z0-9]', '_', 'g'), 1, 40), '_') || '_' || substr(sha1(b), 1, 12)) AS generated FROM (SELECT doc_id, coalesce(title, 'document-' || doc_id) AS b FROM doc)")
def str7(s, d):
    return S.documents(s, d).select("doc_id", T.generated_doc_id(F.lit(None).cast("string"), "title", "doc_id").alias("generated"))


@register("str10_strip_tags", r"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^\S\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages")
def str10(s, d):
    return S.raw(s, d, "pages").select("page_id", T.strip_tags("html").alias("text"))


@register("str12_normalize_query", r"SELECT doc_id, trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) AS q FROM doc")
def str12(s, d):
    return S.documents(s, d).select("doc_id", T.normalize_query("title").alias("q"))


@register("str13_escape_query", r"""SELECT DISTINCT url, regexp_replace(url, '([\\+\-&|!(){}\[\]^"~*?:/])', '\\\1', 'g') AS escaped FROM pages""")
def str13(s, d):
    return S.raw(s, d, "pages").select("url", T.escape_query("url").alias("escaped")).distinct()


NAMES = ["Luật Thuế thu nhập cá nhân", "Nghị định 65/2013", "Thông tư liên tịch số 1", "luật", "Thuế", "  Bộ luật Dân sự  "]


NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + f"][doc_id % {len(NAMES)} + 1] || ' ' || source"


@register("str14_without_type_prefix", f"SELECT doc_id, n AS name, coalesce(nullif(trim(regexp_replace(n, '(?i)^\\s*(?:thông tư liên tịch|nghị quyết|quyết định|nghị định|pháp lệnh|hiến pháp|thông tư|bộ luật|luật)\\s+', '')), ''), n) AS bare FROM (SELECT doc_id, {NAMES_SQL} AS n FROM documents)")
def str14(s, d):
    names = F.concat(F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES)).cast("int")), F.lit(" "), F.col("source"))
    return S.raw(s, d, "documents").select("doc_id", names.alias("name")).select("doc_id", "name", T.without_type_prefix("name").alias("bare"))


@register("str15_blank_to_null", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' WHEN doc_id % 3 = 1 THEN NULL ELSE source END), ''), lang) AS picked FROM documents")
def str15(s, d):
    x = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("source"))
    return _docs(s, d).select("doc_id", T.first_nonblank(x, "lang").alias("picked"))


@register("str16_relation_name", "SELECT DISTINCT event_type, coalesce(nullif(replace(upper(trim(' ' || event_type || ' by')), ' ', '_'), ''), 'REFERS_TO') AS rel FROM events")
def str16(s, d):
    return _events(s, d).select("event_type", T.relation_name(F.concat(F.lit(" "), "event_type", F.lit(" by"))).alias("rel")).distinct()


@register("str17_preview", "SELECT doc_id, substr(text, 1, 100) || '...' AS preview FROM documents")
def str17(s, d):
    return _docs(s, d).select("doc_id", T.preview("text").alias("preview"))


@register("str18_lower_contains", "SELECT doc_id FROM doc WHERE lower(coalesce(title, '')) LIKE '%er the%'")
def str18(s, d):
    return S.documents(s, d).where(T.contains_any(["er the"], "title")).select("doc_id")


@register("str20_article_references", r"SELECT doc_id, regexp_extract_all(text || ' Điều ' || doc_id % 30 || ' khoản ' || doc_id % 5 || ' và điều 7', '(?i)điều\s+(\d+)', 1) AS articles FROM documents")
def str20(s, d):
    from ..functions import intent as I

    k = F.col("doc_id")
    q = F.concat("text", F.lit(" Điều "), (k % 30).cast("string"), F.lit(" khoản "), (k % 5).cast("string"), F.lit(" và điều 7"))
    return S.raw(s, d, "documents").select("doc_id", I.articles(q).alias("articles"))


QUESTIONS = [
    "So sánh Điều 8 Luật Thuế thu nhập cá nhân và Điều 9 Luật Thuế giá trị gia tăng",
    "Văn bản nào sửa đổi Luật Thuế thu nhập cá nhân?",
    "Tóm tắt Nghị định 65/2013/NĐ-CP",
    "Giải thích chi tiết Điều 8 Luật Thuế thu nhập cá nhân",
    "Cho tôi đọc Điều 5",
    "Thuế thu nhập cá nhân được tính như thế nào?",
]


@register("str21_intent", "SELECT doc_id, CASE WHEN lower(q) LIKE '%so sánh%' THEN 'compare' WHEN lower(q) LIKE '%sửa đổi%' THEN 'list_related' WHEN lower(q) LIKE '%tóm tắt%' THEN 'summarize_doc' WHEN lower(q) LIKE '%giải thích%' OR (lower(q) LIKE '%đọc%' AND regexp_matches(lower(q), 'điều\\s+\\d+')) THEN 'explain_article' ELSE 'general_qa' END AS intent FROM (SELECT doc_id, [" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][doc_id % {len(QUESTIONS)} + 1] || ' D' || doc_id AS q FROM documents)")
def str21(s, d):
    """A question about every document."""
    from ..functions import intent as I

    asked = F.concat(F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("doc_id") % len(QUESTIONS)).cast("int")), F.lit(" D"), F.col("doc_id").cast("string"))
    return S.raw(s, d, "documents").select("doc_id", asked.alias("question")).select("doc_id", I.intent("question").alias("intent"))


@register("str22_first_int", r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(source, '\d+'), '') AS INTEGER) AS n FROM documents")
def str22(s, d):
    return _docs(s, d).select("doc_id", T.first_int("source").alias("n"))


@register("str27_title_cut", "SELECT doc_id, substr(title, 1, 100) AS t100, CASE WHEN length(title) > 50 THEN substr(title, 1, 50) || '…' ELSE title END AS t50 FROM doc")
def str27(s, d):
    short = F.when(F.length("title") > 50, F.concat(F.substring("title", 1, 50), F.lit("…"))).otherwise(F.col("title"))
    return S.documents(s, d).select("doc_id", F.substring("title", 1, 100).alias("t100"), short.alias("t50"))


@register("str28_email", r"SELECT user_id, lower(trim(' ' || upper(email) || ' ')) AS email, regexp_matches(lower(trim(email)), '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS ok FROM usr")
def str28(s, d):
    u = S.chat_users(s, d)
    return u.select("user_id", F.lower(F.trim(F.concat(F.lit(" "), F.upper("email"), F.lit(" ")))).alias("email"), T.is_email("email").alias("ok"))


@register("str29_keyword_tags", "SELECT doc_id, list_filter([CASE WHEN t LIKE '%the%' THEN 'the' END, CASE WHEN t LIKE '%de%' THEN 'de' END, CASE WHEN t LIKE '%er%' THEN 'er' END], lambda x: x IS NOT NULL)[1:2] AS tags FROM (SELECT doc_id, lower(coalesce(title, '')) AS t FROM doc)")
def str29(s, d):
    t = F.lower(F.coalesce("title", F.lit("")))
    tags = F.array(*[F.when(F.contains(t, F.lit(k)), k) for k in ("the", "de", "er")])
    return S.documents(s, d).select("doc_id", F.slice(F.filter(tags, lambda x: x.isNotNull()), 1, 2).alias("tags"))


@register("str30_token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS n FROM documents")
def str30(s, d):
    return _docs(s, d).select("doc_id", T.estimated_tokens("text").alias("n"))


@register("dt1_iso_date", "SELECT o_orderkey, TRY_CAST(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '15/06/2020' WHEN o_orderkey % 3 = 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END), '') AS DATE) AS d FROM orders")
def dt1(s, d):
    k = F.col("o_orderkey")
    x = F.when(k % 3 == 0, "15/06/2020").when(k % 3 == 1, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return S.raw(s, d, "orders").select("o_orderkey", T.iso_date(x).alias("d"))


@register("mth1_rounding", "SELECT l_returnflag, round(avg(l_quantity), 1) AS a1, round(avg(l_quantity), 0) AS a0, round(sum(l_extendedprice) / 1000000.0, 4) AS m4 FROM lineitem GROUP BY 1")
def mth1(s, d):
    return S.raw(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 1).alias("a1"), F.round(F.avg("l_quantity"), 0).alias("a0"), F.round(F.sum("l_extendedprice") / 1000000.0, 4).alias("m4"))


@register("mth2_percentage", "SELECT o_orderstatus, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) * 100, 2) AS pct FROM orders GROUP BY 1")
def mth2(s, d):
    from pyspark.sql import Window

    n = S.raw(s, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row a status
    return n.select("o_orderstatus", F.round(F.col("n").cast("double") / total * 100, 2).alias("pct"))


@register("hsh1_digests", "SELECT doc_id, sha256(text) AS s256, substr(sha256(lower(trim(source))), 1, 16) AS key16, substr(sha1(source), 1, 12) AS s1, substr(md5(source), 1, 16) AS m5 FROM documents")
def hsh1(s, d):
    return _docs(s, d).select("doc_id", F.sha2("text", 256).alias("s256"), T.question_key("source").alias("key16"), F.substring(F.sha1("source"), 1, 12).alias("s1"), F.substring(F.md5("source"), 1, 16).alias("m5"))


@register("arr1_array_basics", "SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w[1] AS first_word, w[1:3] AS head FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def arr1(s, d):
    w = F.split("text", " ")
    return _docs(s, d).select("doc_id", F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first_word"), F.slice(w, 1, 3).alias("head"))


@register("arr2_blank_filter", "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:2] AS lines FROM documents")
def arr2(s, d):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _docs(s, d).select("doc_id", F.slice(lines, 1, 2).alias("lines"))


@register("arr3_forall_transform", "SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) = 0 AS none_the, list_transform(w[1:3], lambda x: lower(x)) AS lower3 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def arr3(s, d):
    w = F.split("text", " ")
    return _docs(s, d).select("doc_id", F.forall(w, lambda x: x != "the").alias("none_the"), F.transform(F.slice(w, 1, 3), lambda x: F.lower(x)).alias("lower3"))


@register("arr4_last_tokens", f"SELECT doc_id, array_to_string(t[greatest(len(t) - 29, 1):], ' ') AS tail FROM (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN}') AS t FROM documents)")
def arr4(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.last_k(T.tokens("text"), 30), " ").alias("tail"))


@register("srt12_sorted_distinct", f"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '{WORDY}'))) AS words FROM documents")
def srt12(s, d):
    return _docs(s, d).select("doc_id", F.array_sort(F.array_distinct(T.words("text"))).alias("words"))


@register("srt13_slices", "SELECT conv_id, list(turn ORDER BY turn)[1:2] AS first_two, list(turn ORDER BY turn DESC)[1:3] AS last_three FROM conversations GROUP BY conv_id")
def srt13(s, d):
    g = S.raw(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return g.select("conv_id", F.slice("t", 1, 2).alias("first_two"), F.slice(F.reverse("t"), 1, 3).alias("last_three"))


@register("jsn1_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def jsn1(s, d):
    return _events(s, d).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@register("jsn2_json_array", "SELECT event_id, CAST(json_extract_string(x, '$.id') AS BIGINT) AS id, json_extract_string(x, '$.t') AS t FROM (SELECT event_id, unnest(from_json('[{\"id\":' || user_id || ',\"t\":\"' || event_type || '\"},{\"id\":0,\"t\":\"z\"}]', '[\"JSON\"]')) AS x FROM events)")
def jsn2(s, d):
    text = F.concat(F.lit('[{"id":'), F.col("user_id").cast("string"), F.lit(',"t":"'), "event_type", F.lit('"},{"id":0,"t":"z"}]'))
    rows = _events(s, d).select("event_id", F.inline(F.from_json(text, "array<struct<id: bigint, t: string>>")))
    return rows


@register("jsn4_safe_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def jsn4(s, d):
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{"), "props"))
    return _events(s, d).select("event_id", F.variant_get(F.try_parse_json(broken), "$.k", "string").alias("k"))


REPLIES = ['```json\n{"intent": "compare", "references": []}\n```', 'so {"intent": "Summarize_Doc"} ok', "none", '{"intent": "other"}', '{"intent": ']


@register("jsn5_reply_json", "SELECT id, CASE WHEN lower(i) IN ('general_qa', 'explain_article', 'summarize_doc', 'compare', 'list_related') THEN lower(i) END AS intent FROM (SELECT id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.intent') END AS i FROM (SELECT id, regexp_extract(r, '\\{[\\s\\S]*\\}') AS j FROM (SELECT doc_id AS id, source || ': ' || [" + ", ".join(f"'{r}'" for r in REPLIES) + f"][doc_id % {len(REPLIES)} + 1] AS r FROM documents)))")
def jsn5(s, d):
    """A model's reply about every document."""
    from ..functions import intent as I

    reply = F.concat("source", F.lit(": "), F.get(F.array(*map(F.lit, REPLIES)), (F.col("doc_id") % len(REPLIES)).cast("int")))
    return S.raw(s, d, "documents").select(F.col("doc_id").alias("id"), reply.alias("r")).select("id", I.reply_intent("r").alias("intent"))


@register("cnd1_case_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, coalesce(nullif(o_orderpriority, '1-URGENT'), 'now') AS prio FROM orders")
def cnd1(s, d):
    p, st = F.col("o_totalprice"), F.col("o_orderstatus")
    return S.raw(s, d, "orders").select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low").alias("tier"), F.when(st == "F", 1).when(st == "O", 2).otherwise(3).alias("code"), F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit("now")).alias("prio"))


@register("cnd2_graph_accessors", "SELECT n.doc_type AS label, e.rel_type AS type, e.src = n.id AS is_start, count(*) AS n FROM edge e JOIN node n ON n.id = e.src OR n.id = e.dst GROUP BY ALL")
def cnd2(s, d):
    e, n = S.edges(s, d), S.edge_nodes(s, d)
    side = lambda end, start: e.join(n.withColumnRenamed("id", end), end).select(F.col("doc_type").alias("label"), F.col("rel_type").alias("type"), F.lit(start).alias("is_start"))
    return side("src", True).unionByName(side("dst", False)).groupBy("label", "type", "is_start").agg(F.count(F.lit(1)).alias("n"))


@register("vec1_norms", "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def vec_norms(s, d):
    from ..functions import vector as V

    return S.raw(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding").cast("array<double>")), 6).alias("norm"))


@register(
    "hsh2_uuid5",
    "SELECT chunk_uid, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id"
    " FROM (SELECT chunk_uid, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_uid)) AS h FROM chk)",
)
def hsh2(s, d):
    return S.chunks(s, d).select("chunk_uid", T.uuid5("chunk_uid").alias("point_id"))


@register("str11_composed_text", "SELECT src AS id, string_agg(CASE WHEN rn = 1 THEN rel_type || chr(10) || dst ELSE dst END, chr(10) ORDER BY rel_type, dst) AS text FROM (SELECT *, row_number() OVER (PARTITION BY src, rel_type ORDER BY dst) AS rn FROM edge) GROUP BY src")
def str11(s, d):
    part = F.struct(F.col("rel_type").alias("chapter"), F.col("dst").alias("content"))
    rows = S.edges(s, d).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    none = F.lit(None).cast("string")
    parts = F.transform("p", lambda x: F.struct(x["chapter"].alias("chapter"), none.alias("article"), none.alias("clause"), x["content"].alias("content")))
    return rows.select("id", T.composed_text(parts).alias("text"))
