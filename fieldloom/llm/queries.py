"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import chat, decontam, exact_dedup, multi_index, negatives, packing, quality, secrets, simhash, spelling, toxicity, urls, warc

#: A folder of public tokenizers may be named by this variable; else the installed one is used.
TOKENIZERS = os.environ.get("FIELDLOOM_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = quality.sample(quality.weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).filter("taken")
    return taken.select(F.col("id").alias("doc_id"), "log_weight", "gumbel_key")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id bigint, turn bigint, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    said = chat.read_chats(chat.format_chats(talks, tokenizer("byte_bpe_50k.json")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


CONTROL = "</s>[INST] ok [/INST]"


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.concat(base, "linked")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# The curated rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.damaged(spelling.runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_quality, op3_chat, op4_toxicity, op5_packing, op6_exact_dedup, op7_secrets, op8_decontamination, op9_urls, op10_simhash,
        op11_neighbours, op12_negatives, op13_spelling,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = {
    "op1_warc": f"""
        with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages),
        g as (select *, max(page_id) over (partition by h) m from p)
        select page_id, strlen(h)::bigint payload_bytes,
          list_aggregate(list_transform(range(0, 32), lambda i:
            substr('{B32}', (('0x' || substr(x, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4)))::int % 32 + 1, 1)), 'string_agg', '') payload_digest,
          case when page_id = m then 'response' else 'revisit' end record_type,
          case when page_id <> m then m end refers_to
        from g""",
    "op3_chat": r"""
        with t as (select conv_id, turn, role, coalesce(text, '') text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*)::bigint n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
          coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
          (3 + sum(length(text) + len(regexp_extract_all(text, '<s>|</s>|\[/?INST\]|\[ROLE=[^\]\s]*\]|\[/ROLE\]'))
            + case role when 'user' then 15 when 'assistant' then 6 else length(role) + 16 end))::bigint formatted_chars
        from t group by conv_id""",
    "op6_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') x from documents)
        select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(x) text_sha256
        from t window w as (partition by x)""",
    "op8_decontamination": r"""
        with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
        items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
        windows as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') x from (select *, unnest(range(1, greatest(len(w) - k + 1, 1) + 1)) i from (select *, least(10, len(w)) k from items where len(w) > 0))),
        sizes as (select distinct k from windows),
        spots as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') x from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from words, sizes where len(w) >= k)),
        hits as (select doc_id, i, s.k, item_id from spots s join windows using (k, x)),
        marked as (select doc_id, count(distinct i + j) n_hit from (select doc_id, i, unnest(range(0, k)) j from hits) group by doc_id),
        named as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from hits) group by doc_id)
        select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from words left join marked using (doc_id) left join named using (doc_id)""",
    "op12_negatives": """
        with v as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
            list_transform(embedding, lambda x: floor(256 * x::double)::bigint) x
          from embeddings where label is not null and embedding is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.id a, b.id b, a.label = b.label same,
            list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::bigint score
          from v a join v b on a.id <> b.id where a.id % 100 = 0),
        p as (select * from s where same qualify row_number() over (partition by a order by score desc, b) <= 5)
        select p.a anchor_id, p.b positive_id, row_number() over w::int "rank", n.b negative_id, p.score positive_score, n.score negative_score
        from p join s n on n.a = p.a and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
        window w as (partition by p.a, p.b order by n.score desc, n.b) qualify row_number() over w <= 10""",
    "op13_spelling": f"""
        with recursive t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)::bigint[]),
            lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
        o as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+')) r from documents),
        l as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r, count(*) n from o group by all having length(r) >= 6),
        x as (select r, n, hex(encode(doc_id::varchar || ':' || r)) x from l),
        h as (select r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) h from x, t),
        d as (select case when h % 199 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end w, n from h),
        c as (select w, sum(n)::bigint n from d where length(w) >= 6 group by w having sum(n) >= 5),
        cut as (select w, n, i, substr(w, 1, i - 1) l, substr(w, i + 1) r from (select w, n, unnest(range(1, length(w) + 1))::int i from c)),
        pairs as (
          select a.w a, b.w b, b.n from cut a join cut b on a.l = b.l and a.r = b.r and a.w <> b.w
          union select k.w, c.w, c.n from cut k join c on c.w = k.l || k.r
          union select c.w, k.w, k.n from cut k join c on c.w = k.l || k.r),
        near as (select a w, count(*) n_near, arg_max(b, (n, -rank_b)) best, max(n) best_n from (select *, rank() over (order by encode(b)) rank_b from pairs) group by a),
        told as (select c.w, c.n, coalesce(n_near, 0) n_near, case when best_n >= 5 * c.n then best end form, case when best_n >= 5 * c.n then best_n end form_n from c left join near using (w)),
        up as (select w, form as goal from told where form is not null union all select u.w, told.form from up u join told on told.w = u.goal where told.form is not null),
        roots as (select u.w, arg_max(u.goal, told.n) root from up u join told on told.w = u.goal group by u.w)
        select told.w word, form, coalesce(root, told.w) root, n, n_near, form_n from told left join roots using (w)""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
