"""Word statistics and topics of whole post titles."""

from pyspark.sql import functions as F

from odflux.catalog.inputs import rounded
from odflux.catalog.registry import query
from odflux.operators import segment, text, topics
from odflux.operators.aggregates import array_sum_by
from odflux.session import materialize, shuffles_dropped

MIN_COUNT = 100


def _vocabulary(t):
    """Counted and written once, however often a query reads it."""
    if not hasattr(t, "_words"):
        t._words = materialize(text.word_count(t.post(), "title", min_count=MIN_COUNT), "vocabulary")
    return t._words


@query("txt01_tokenize", "select doc_id, count(*) as words, count(distinct word) as kinds, min(word) as first_word from token group by doc_id")
def _(t):
    words = text.word_stream(t.post(), "title", ["doc_id"])
    return words.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count_distinct("word").alias("kinds"), F.min("word").alias("first_word")
    )


@query(
    "txt01_segment_without_blanks",
    """with recursive word as (
         select word, floor(1000 * ln(sum(cnt) over () / cnt))::bigint as cost, floor(1000 * ln(sum(cnt) over ()))::bigint + 1000 as unknown
         from (select word, count(*)::double as cnt from (select unnest(string_split(p_name, ' ')) as word from part
               union all select replace(p_name, ' ', '') from part where p_size > 45) group by word)
       ), joined as (select distinct replace(p_name, ' ', '') as run from part),
       way as (
         select run, 1 as pos, 0::bigint as cost, []::integer[] as steps, []::varchar[] as words from joined
         union all
         select run, pos + length(w), cost + c, list_append(steps, -length(w)), list_append(words, w)
         from (select way.*, word.word as w, word.cost as c from way join word on substr(run, pos, length(word.word)) = word.word
               union all select way.*, substr(run, pos, 1), (select max(unknown) from word) from way where pos <= length(run))
       )
       select p_partkey, array_to_string(words, ' ') as words
       from part join (select run, arg_min(words, (cost, steps)) as words from way where pos = length(run) + 1 group by run)
       on replace(p_name, ' ', '') = run""",
)
def _(t):
    names = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("joined"))
    single = t.part.select(F.explode(F.split("p_name", " ")).alias("word"))
    whole = t.part.where("p_size > 45").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("word"))
    words = single.unionByName(whole).groupBy("word").agg(F.count("*").alias("cnt"))
    found = segment.segment(names, "p_partkey", "joined", words)
    return found.select("p_partkey", F.array_join("tokens", " ").alias("words"))


@query("txt02_word_count", "select word, cnt from vocabulary")
def _(t):
    return text.word_count(t.post(), "title", min_count=MIN_COUNT)


@query(
    "txt03_inverse_document_frequency",
    """select word, round(ln((select count(*) from post) / count(distinct doc_id)), 6) as idf
       from token where word in (select word from vocabulary) group by word""",
)
def _(t):
    return rounded(text.inverse_document_frequency(t.post(), "title", _vocabulary(t)), 6, "idf")


MD5 = "('0x' || substr(md5(concat_ws('|', cast(doc_id as varchar), '42')), 1, 8))::bigint < 1288490188"


@query(
    "txt03_idf_of_a_sample",
    f"""select word, round(ln((select count(*) from post where {MD5}) / count(distinct doc_id)), 6) as idf
        from token where word in (select word from vocabulary) and {MD5} group by word""",
)
def _(t):
    idf = text.inverse_document_frequency(t.post(), "title", _vocabulary(t), fraction=0.3, keys=["doc_id"])
    return rounded(idf, 6, "idf")


@query(
    "txt04_tf_vector",
    """select doc_id, word, round(count(*) / sum(count(*)) over (partition by doc_id), 6) as tf
       from token where word in (select word from vocabulary) group by doc_id, word""",
)
def _(t):
    return rounded(text.tf_vector(t.post(), "doc_id", "title", _vocabulary(t)), 6, "tf")


@query(
    "txt04_tf_idf_vector",
    """select doc_id, word, round(n / total * idf, 6) as tf
       from (select doc_id, word, count(*) as n, sum(count(*)) over (partition by doc_id) as total from token group by doc_id, word)
       join (select word, ln((select count(*) from post) / count(distinct doc_id)) as idf from token
             where word in (select word from vocabulary) group by word) using (word)""",
)
def _(t):
    vocabulary = _vocabulary(t)
    idf = text.inverse_document_frequency(t.post(), "title", vocabulary)
    return rounded(text.tf_vector(t.post(), "doc_id", "title", vocabulary, norm=False, idf=idf), 6, "tf")


K, SEED, KMEANS_ROUNDS = 30, 1, 20

WEIGHTS = {
    "weight": """
        select doc_id, word, count(*) / sum(count(*)) over (partition by doc_id) as tf
        from token where word in (select word from vocabulary) group by doc_id, word""",
    "kx": f"select * from (select doc_id, word, cast(floor(tf * {topics.STEPS}) as bigint) as x from weight) where x > 0",
    "kd": """
        select doc_id, coalesce(xx, 0) as xx, coalesce(sig, '') as sig
        from post left join (select doc_id, cast(sum(x * x) as bigint) as xx, md5(string_agg(word || ':' || x, ' ' order by word)) as sig
                             from kx group by doc_id) using (doc_id)""",
    "kn0": "select doc_id, xx, sig, null::bigint as s, null::integer as topic from kd",
}


def _nearest_sql(centres, norms, before=None):
    """Smallest (score, topic) per document, over the scores of a round and those before it."""
    kept = f"select doc_id, s, topic from {before} where topic is not null union all" if before else ""
    return f"""
        select doc_id, xx, sig, min(q.s) as s, arg_min(q.topic, (q.s, q.topic)) as topic
        from kd join ({kept} select kx.doc_id, nn - 2 * cast(sum(x * w) as bigint) as s, topic
                      from kx join {centres} using (word) join {norms} using (topic) group by kx.doc_id, topic, nn
                      union all select kd.doc_id, nn, topic from kd, (select nn, topic from {norms} order by nn, topic limit 1)) q
        using (doc_id) group by doc_id, xx, sig"""


def _kmeans_sql():
    """Views of all draws and rounds; ``ktopic`` has the topics."""
    views, have, drawn = dict(WEIGHTS), 0, []
    while have < K:
        n, i = min(max(have, 1), K - have), len(drawn) + 1
        views[f"kt{i}"] = f"""
            select cast(row_number() over (order by o, doc_id) - 1 + {have} as integer) as topic, doc_id, xx as nn
            from (select min(o) as o, arg_min(doc_id, (o, doc_id)) as doc_id, any_value(xx) as xx
                  from (select *, -ln((('0x' || substr(md5(concat_ws(':', doc_id, {SEED}, {have})), 1, 13))::bigint + 1) / {1 << topics.BITS}.0::double)
                                  / (case when topic is null then 1 else xx + s end) as o
                        from kn{i - 1} where topic is null or xx + s > 0)
                  group by sig order by 1, 2 limit {n})"""
        views[f"kc{i}"] = f"select topic, word, x as w from kt{i} join kx using (doc_id)"
        views[f"kn{i}"] = _nearest_sql(f"kc{i}", f"kt{i}", f"kn{i - 1}")
        drawn.append(i)
        have += n
    views["ka0"] = f"select * from kn{drawn[-1]}"
    for r in range(1, KMEANS_ROUNDS + 1):
        views[f"ks{r}"] = f"select topic, count(*) as n from ka{r - 1} group by topic"
        views[f"kr{r}"] = f"""
            select * from (select topic, word, cast(sum(x) as bigint) // n as w
                           from kx join ka{r - 1} using (doc_id) join ks{r} using (topic) group by topic, word, n) where w > 0"""
        views[f"kw{r}"] = f"select topic, cast(coalesce(sum(w * w), 0) as bigint) as nn from ks{r} left join kr{r} using (topic) group by topic"
        views[f"ka{r}"] = _nearest_sql(f"kr{r}", f"kw{r}")
    views["ktopic"] = f"select doc_id, topic from ka{KMEANS_ROUNDS}"
    return views


KMEANS = _kmeans_sql()


def _weights(t):
    posts = t.post().na.drop(subset=["city", "startdate", "title"])
    with shuffles_dropped(t.spark):
        return posts, materialize(text.tf_vector(posts, "doc_id", "title", _vocabulary(t)), "weights")


def _topics(t):
    posts, weights = _weights(t)
    return weights, topics.kmeans_topics(posts, weights, "doc_id", K, SEED, KMEANS_ROUNDS)


@query("txt05_kmeans_topics", "select doc_id, topic from ktopic", KMEANS)
def _(t):
    return _topics(t)[1]


@query("txt06_gmm_topics")
def _(t):
    posts, weights = _weights(t)
    soft = topics.soft_topics(posts, weights, "doc_id", k=4, dims=4, max_iter=10)
    soft = soft.withColumn("time", F.substring("startdate", 1, 7))
    return array_sum_by(soft, ["city", "time"], "probability")


@query(
    "txt06_projected_words",
    "select doc_id, " + ", ".join(
        f"""round(coalesce(sum(case when (('0x' || substr(md5(word || ':1:0'), 1, 13))::bigint >> {j}) & 1 = 1 then tf else -tf end), 0)
            / sqrt(8), 6) as p{j}""" for j in range(8)
    ) + " from post left join weight using (doc_id) group by doc_id",
    WEIGHTS,
)
def _(t):
    posts, weights = _weights(t)
    wide = topics.project(posts, weights, "doc_id", 8).select("doc_id", *[F.col("reduced")[j].alias(f"p{j}") for j in range(8)])
    return rounded(wide, 6, *[f"p{j}" for j in range(8)])


@query(
    "txt07_topic_counts_of_clusters",
    """select city as name, strftime(cast(startdate as date), '%Y%m') as time, topic, count(*) as cnt
       from post join ktopic using (doc_id) group by all""",
    KMEANS,
)
def _(t):
    return text.topic_counts(t.post().join(_topics(t)[1], "doc_id"))


@query(
    "txt07_topic_counts",
    """select city as name, strftime(cast(startdate as date), '%Y%m') as time, (doc_id % 30)::integer as topic, count(*) as cnt
       from post group by all""",
)
def _(t):
    return text.topic_counts(t.post().withColumn("topic", (F.col("doc_id") % 30).cast("int")))


def _matrix_sql(of):
    return f"""
        select word, {', '.join(f'round(coalesce(max(case when topic = {i} then mean end), 0), 6) as K{i}' for i in range(K))}
        from vocabulary left join (
          select word, topic, sum(tf) / any_value(docs) as mean
          from weight join (select doc_id, topic, count(*) over (partition by topic) as docs from {of}) using (doc_id)
          group by word, topic) using (word) group by word"""


@query("txt08_topic_word_matrix", _matrix_sql("ktopic"), KMEANS)
def _(t):
    weights, found = _topics(t)
    out = text.topic_word_matrix(weights, found, _vocabulary(t), "doc_id", K)
    return rounded(out, 6, *[f"K{i}" for i in range(K)])


@query(
    "txt08_topic_word_matrix_of_given_topics",
    _matrix_sql("(select doc_id, doc_id % 30 as topic from post)"),
    WEIGHTS,
)
def _(t):
    topics = t.post().select("doc_id", (F.col("doc_id") % 30).cast("int").alias("topic"))
    weights = text.tf_vector(t.post(), "doc_id", "title", _vocabulary(t), norm=True)
    out = text.topic_word_matrix(weights, topics, _vocabulary(t), "doc_id", 30)
    return rounded(out, 6, *[f"K{i}" for i in range(30)])
