"""The queries of the corpus operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import centroids, decontaminate, ffd, fingerprint, jaccard, langid, packing, quality, repeats, resample, secrets, tokenfile, toxicity
from factledger.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.find_secrets(table(spark, sf_dir, "documents"))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op4_secret_scan`` that SQL can repeat."""
    return op4_secret_scan(spark, sf_dir).drop("spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = tokenfile.new_target(spark)
    tokenfile.write(table(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.checksums(tokenfile.read(spark, target))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint.fingerprint_with_next(docs, fingerprint.lexicon(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_token_output": op6_token_output,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_first_fit_packing": op11_first_fit_packing,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_importance_resampling": op13_importance_resampling,
    "secret_base_spans": secret_base_spans,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _kind_sql(order: int, kind: str, pattern: str, keep: str) -> str:
    """Places of the matches of a pattern: what stands between them tells where they begin."""
    return f"""select doc_id, {order} as k, '{kind}' as kind, unnest(range(1, len(m) + 1)) as i, m, g from (select doc_id, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from d where regexp_matches(t, '{pattern}'))""", keep


_ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+"""
_KINDS = [
    _kind_sql(0, "assign", _ASSIGN, "length(regexp_extract(raw, '(?i:(?:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?)([A-Za-z0-9+/_.=-]+)', 1)) >= 12"),
    _kind_sql(1, "access", "AKIA[A-Z0-9]+", "length(raw) >= 18"),
    _kind_sql(2, "hex", "[0-9a-f]+", "length(raw) >= 16"),
]



def _clusters_sql(rounds: int = 5, k: int = 40) -> str:
    """Each round's nearest centroids and floors of means, by plain distances to every centroid."""
    first = f"row_number() over (order by sha256('2:' || vec_id), x)"
    out = f"""with e as (select row_number() over () as r, vec_id, x from (select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
        from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = 64)),
    c0 as (select {first} - 1 as c, x from e where vec_id is not null qualify {first} <= {k})"""
    for i in range(rounds + 1):
        out += f""",
    a{i} as materialized (select e.r, any_value(e.vec_id) as vec_id, any_value(e.x) as x, min({{'d': list_sum(list_transform(list_zip(e.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'c': c.c}}) as best from e cross join c{i} c group by e.r)"""
        if i < rounds:
            out += f""",
    s{i} as (select c, i, s // n - case when s % n < 0 then 1 else 0 end as m from (select best.c as c, i, sum(x[i])::bigint as s, count(*) as n from (select best, x, unnest(range(1, 65)) as i from a{i}) group by all)),
    c{i + 1} as materialized (select c.c, coalesce(m.x, c.x) as x from c{i} c left join (select c, list(m order by i) as x from s{i} group by c) m on m.c = c.c)"""
    return out + f"""
    select vec_id, best.c::int as cluster, best.d as distance, sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
        sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{rounds} join c{rounds} c on c.c = best.c"""


def _resampling_sql() -> str:
    """Every feature's CRC-32 byte by byte, with the usual table of 256 made by its rule."""

    def words(table: str) -> str:
        return f"select row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w, * from {table}"

    def runs(table: str) -> str:
        two, three = "w[i] || ' ' || w[i + 1]", "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]"
        return f"select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: {two}), list_transform(range(1, len(w) - 1), lambda i: {three}))) as f from {table}"

    return f"""with recursive bits as (select i, i::bigint as x, 0 as k from range(256) t(i) union all select i, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from bits where k < 8),
    tab as (select list(x order by i) as tab from bits where k = 8),
    dw as ({words("documents")}), tw as ({words("benchmark")}), df as ({runs("dw")}), tf as ({runs("tw")}),
    bytes as (select f, list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), cast(2 * i - 1 as bigint), 2))::bigint) as b from (select f from df union select f from tf)),
    crc as (select f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[cast((xor(c, x) & 255) + 1 as bigint)])), 4294967295) % 10000 as bucket from bytes, tab),
    s as (select bucket, count(*) as s from df join crc using (f) group by bucket), t as (select bucket, count(*) as t from tf join crc using (f) group by bucket),
    n as (select (select count(*) from df)::double as s_all, (select count(*) from tf)::double as t_all),
    g as (select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (s_all + 10000) / ((coalesce(s, 0)::double + 1) * (t_all + 10000))))::bigint as gain from s full join t using (bucket), n),
    x as (select r, count(*) as n, sum(gain)::bigint as weight from df join crc using (f) join g using (bucket) group by r),
    y as (select doc_id, r, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from dw left join x using (r)),
    z as (select r, row_number() over (order by score desc, doc_id, n_features) as rank, count(*) over () as able from y where n_words >= 20)
    select doc_id, n_features, weight, score, case when rank <= 5 * able // 100 then rank end as rank from y left join z using (r)"""


ORACLES: dict[str, str] = {
    "op13_importance_resampling": _resampling_sql(),
    "op12_centroid_clustering": _clusters_sql(),
    "secret_base_spans": "with d as (select doc_id, coalesce(text, '') as t from documents), "
    + ", ".join(f"x{i} as ({sql}), y{i} as (select doc_id, k, kind, m[i] as raw, list_sum([length(z) for z in g[1:i]]) + list_sum([length(z) for z in m[1:i]]) - length(m[i]) as a from x{i}), z{i} as (select * from y{i} where {keep})" for i, (sql, keep) in enumerate(_KINDS))
    + """, s as (select doc_id, k, cast(a as bigint) as a, kind || ':' || cast(a as bigint) || ':' || cast(a + length(raw) as bigint) as label from (select * from z0 union all select * from z1 union all select * from z2))
    select d.doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, sha256(coalesce(string_agg(label, ',' order by a, k), '')) as base_sha256 from d left join s using (doc_id) group by d.doc_id""",
    "op7_ngram_jaccard_join": f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    g as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5) union select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
    n as (select doc_id, count(*) as n from g group by doc_id), p as (select a.doc_id as a, b.doc_id as b, count(*) as i from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
    e as (select a, b, i = x.n and i = y.n as same from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
    c as (select doc_id as node, doc_id as root from w union select e.b, c.root from c join e on e.a = c.node)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, (select min(root) from c where node = w.doc_id) as component_id, least(w.doc_id, coalesce((select min(b) from e where a = w.doc_id and same), w.doc_id)) as class_id, (select count(*) from e where a = w.doc_id) as n_links from w left join n using (doc_id)""",
}
