"""The operators as queries over the tables: ``QUERIES`` and, where SQL can express them, ``SQL``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, hnsw, jaccard, langid, lexical, licenses, mixing, neardup, packing, secrets, suffixes, urls, warc
from .common import Scratch, table

#: Target shares of op1 and the pipeline. Values that are not named keep their share.
TARGETS = {
    "source": {"src0": 0.12} | {f"src{i}": 0.88 / 19 for i in range(1, 20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"figures": 0.1, "lists": 0.15, "short": 0.25, "long": 0.5},
}
MIX_RATE = 0.35


def topic(text: Column) -> Column:
    """A stand-in for a topic model: the shape of the text, by its digits, line breaks and length."""
    chars = F.char_length(text)
    digits, lines = F.regexp_count(text, F.lit("[0-9]")), F.regexp_count(text, F.lit("\n"))
    return F.when(text.isNull() | (chars == 0), None).when(digits * 50 >= chars, "figures").when(lines * 120 >= chars, "lists").when(chars < 2000, "short").otherwise("long")


def mixed(docs: DataFrame, rate: float | None = MIX_RATE) -> DataFrame:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    return mixing.mix(docs, dims, TARGETS, mixing.tokens_of(F.col("text")), F.col("doc_id"), rate)


def op1_mixing_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample with the weights under which its tokens meet the targets."""
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 6).alias("probability"), F.round("mix_weight", 6).alias("weight"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing_weighted(spark, sf_dir).drop("weight")


def _op1_sql(rounds: int = 30, weighted: bool = False) -> str:
    """Cell weights by a recursive table: each step rakes to one marginal, so a round is three steps."""
    cat = lambda c, d: f"case when {c} in ({', '.join(repr(k) for k in TARGETS[d])}) then {c} else '(other)' end"
    target = "select * from (values " + ", ".join(f"('{d}', '{k}', {v!r}::double)" for d in TARGETS for k, v in TARGETS[d].items()) + ") t(dim, val, share)"
    shape = "case when text is null or length(text) = 0 then null when length(regexp_replace(text, '[^0-9]', '', 'g')) * 50 >= length(text) then 'figures' when (length(text) - length(replace(text, chr(10), ''))) * 120 >= length(text) then 'lists' when length(text) < 2000 then 'short' else 'long' end"
    dims = list(TARGETS)
    wanted = f"case when t > 0 then w / t else 0 end * {MIX_RATE}"
    by = "case m % 3 " + " ".join(f"when {i} then {d}" for i, d in enumerate(dims)) + " end"
    return f"""
with recursive tagged as materialized (
  select doc_id, {cat('source', 'source')} as source, {cat('lang', 'lang')} as lang, {cat(f'({shape})', 'topic')} as topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents),
target as materialized ({target}),
cells as materialized (select source, lang, topic, sum(tokens)::double as t from tagged group by all),
sums as materialized (select 'source' as dim, source as val, sum(t) as t from cells group by all union all select 'lang', lang, sum(t) from cells group by all union all select 'topic', topic, sum(t) from cells group by all),
held as materialized (
  select s.dim, s.val, case when s.val = '(other)' then s.t / (select sum(t) from cells)
    else g.share / sum(g.share) over (partition by s.dim) * (1 - coalesce((select o.t from sums o where o.dim = s.dim and o.val = '(other)'), 0) / (select sum(t) from cells)) end as share
  from sums s left join target g on g.dim = s.dim and g.val = s.val where s.t > 0 or s.val = '(other)'),
fit as (
  select 0 as m, source, lang, topic, t, t as w from cells
  union all
  select m + 1, source, lang, topic, t, case when sum(w) over (partition by {by}) > 0 then
      w * h.share * sum(t) over () / sum(w) over (partition by {by}) else w end
  from fit left join held h on h.dim = case m % 3 when 0 then 'source' when 1 then 'lang' else 'topic' end and h.val = {by}
  where m < {3 * rounds}),
ratio as (select source, lang, topic, least(1.0, {wanted}) as p{f', greatest(1.0, {wanted}) as weight' if weighted else ''} from fit where m = {3 * rounds})
select doc_id, source, lang, topic, tokens, round(p, 6) as probability{', round(weight, 6) as weight' if weighted else ''} from tagged join ratio using (source, lang, topic)
where ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '(none)')), 1, 12))::bigint / 281474976710656.0 < p"""


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = langid.fit(docs, ~held_out)
    out = langid.predict(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secrets", lambda x: x.k == k)).cast("long")
    base = F.filter("secrets", lambda x: x.k < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x.license)))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x.contained)), F.lit(0.0)).alias("contained"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    files = scratch.save(warc.write(warc.deduplicated(table(spark, sf_dir, "pages")), f"{scratch.root}/archives"), "files")
    got = warc.read(spark, files, scratch.root, with_payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.fit(urls.labelled(spark))).select("page_id", "host", "path", "rule", "verdict")


_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP11_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all({_SMALL.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
q as materialized (select row_number() over () as q, item_id, regexp_extract_all({_SMALL.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from (select distinct item_id, text from benchmark where text is not null)),
qt as materialized (select q, t, count(*) as times from (select q, unnest(ts) as t from q) group by all),
size as materialized (select r, doc_id, len(ts)::bigint as n from d where len(ts) > 0),
total as materialized (select count(*)::bigint as big_n, sum(n)::bigint as big_l from size),
post as materialized (select r, t, count(*)::bigint as tf from (select r, unnest(ts) as t from d) where t in (select t from qt) group by all),
weight as materialized (select t, floor(1000 * ln((2.0::double * big_n + 2) / (2 * df + 1)))::bigint as w from (select t, count(*) as df from post group by t), total),
value as (select r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) as v from post join weight using (t) join size using (r), total),
score as (select q, r, sum(times * v)::bigint as score from value join qt using (t) group by all having sum(times * v) > 0)
select item_id, rank, doc_id, score from (select item_id, cast(row_number() over (partition by q order by score desc, doc_id) as int) as rank, doc_id, score from score join size using (r) join q using (q)) where rank <= 20"""
_OP12_SQL = f"""
with d as materialized (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
occ as materialized (select r, lang, source, t, count(*)::bigint as n from (select r, lang, source, unnest(ts) as t from d) group by all),
kept as materialized (select lang, t, sum(n)::bigint as n from occ group by all having count(*) >= {divergence.LEAST_DOCS}),
v as materialized (select lang, count(*)::bigint as v, sum(n)::bigint as n from kept group by all),
g as materialized (select distinct lang, source from d),
own as materialized (select lang, source, t, sum(o.n)::bigint as n from occ o join kept using (lang, t) group by all),
size as materialized (select lang, source, coalesce(sum(n), 0)::bigint as n from g left join own using (lang, source) group by all),
p as materialized (select s.lang, s.source, k.t, coalesce(o.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)) // (s.n + 5 * v.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v) as q
  from size s join v using (lang) join kept k using (lang) left join own o on o.lang = s.lang and o.source = s.source and o.t = k.t),
diff as materialized (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join diff on diff.lang = a.lang and diff.source = a.source and diff.item = b.source),
term as (select lang, source, 'term' as part, t as item, (p - q)::bigint as value from p where n > 0 and p > q)
select lang, source, part, item, value, rank from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pair union all select * from term))
where part = 'pair' or rank <= 50"""


def _op13_sql(steps: int = 400, pull: float = 0.88) -> str:
    """The same regression by accelerated gradient steps."""
    lab = ", ".join(f"('{u}', {k})" for k, names in enumerate((urls.ALLOWED, urls.BLOCKED)) for u in urls.addresses(names))
    host = "translate(coalesce(regexp_extract(url, '{}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format(urls.PARTS)
    path = f"coalesce(regexp_extract(url, '{urls.PARTS}', 2), '')"

    def grams(text: str, salt: int, n: int) -> str:
        h = str(salt * 16 + n)
        for k in range(n):
            h = f"(({h}::bigint * {urls.FACTOR} + c[i + {k + 1}]) % {urls.MODULUS})"
        return f"select id, unnest(list_transform(range(len(c) - {n - 1}), lambda i: {h} % {urls.BUCKETS})) as k from (select id, list_transform(regexp_extract_all({text}, '(?s).'), lambda x: unicode(x)::bigint) as c from seen)"

    feats = " union all ".join(grams(text, salt, n) for salt, text in ((1, "'^' || host || '$'"), (2, "path || '$'")) for n in urls.GRAMS)
    rate = 1 / (0.5 + urls.PENALTY)
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    order = sorted(urls.RULES, key=lambda r: (-len(r.text), r.text))
    case = lambda what, rest: "case " + " ".join(f"when {fits(r)} then '{what(r)}'" for r in order) + f" else {rest} end"
    return f"""
with recursive lab as materialized (select row_number() over () as i, * from (values {lab}) t(url, y)),
seen as materialized (select -i as id, url, {host} as host, {path} as path from lab union all select page_id, url, {host}, {path} from pages),
found as materialized (select id, k, count(*)::double as n from ({feats}) group by all),
x as materialized (select id, k, n / sqrt(sum(n * n) over (partition by id)) as x from found),
train as materialized (select i, y, k, x from lab join x on x.id = -i union all select i, y, -1, 1.0 from lab),
fit as (
  select 0 as step, k, 0.0::double as w, 0.0::double as v from (select distinct k from train)
  union all
  select step + 1, k, v - {rate} * (g + case when k >= 0 then {urls.PENALTY} * v else 0 end),
    (v - {rate} * (g + case when k >= 0 then {urls.PENALTY} * v else 0 end)) * {1 + pull} - {pull} * w
  from fit join (select t.k, avg_sum / (select count(*) from lab) as g from (select t.k, sum(t.x * (1 / (1 + exp(-m)) - t.y)) as avg_sum from train t join (select i, sum(x * v) as m from train join fit using (k) group by i) using (i) group by t.k) t) using (k)
  where step < {steps}),
last as materialized (select k, w from fit where step = {steps}),
margin as materialized (select id, sum(x * w) + (select w from last where k = -1) as m from x join last using (k) group by id)
select page_id, host, path, {case(lambda r: r.text, 'null')} as rule, {case(lambda r: r.verdict, f"case when coalesce(m, (select w from last where k = -1)) > 0 then 'block' else 'allow' end")} as verdict
from (select id as page_id, host, path from seen where id >= 0) s left join margin on margin.id = s.page_id"""


QUERIES = {"op1_mixing": op1_mixing, "op2_hnsw": op2_hnsw, "op3_jaccard": op3_jaccard, "op4_langid": op4_langid, "op5_suffixes": op5_suffixes, "op6_secrets": op6_secrets, "op7_packing": op7_packing, "op8_neardup": op8_neardup, "op9_licenses": op9_licenses, "op10_warc": op10_warc, "op1_mixing_weighted": op1_mixing_weighted, "op11_lexical": op11_lexical, "op12_divergence": op12_divergence, "op13_urls": op13_urls}
SQL = {
    "op11_lexical": _OP11_SQL,
    "op12_divergence": _OP12_SQL,
    "op13_urls": _op13_sql(),
    "op1_mixing": _op1_sql(),
    "op1_mixing_weighted": _op1_sql(weighted=True),
    "op10_warc": """
select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type, case when n >= 100 and page_id > first then first end as refers_to
from (select page_id, html, octet_length(encode(coalesce(html, ''))) as n, min(page_id) over (partition by coalesce(html, '')) as first from pages)""",
}
