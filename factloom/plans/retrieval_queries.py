"""Registered queries over texts, vectors and pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as X
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import authority as AU
from ..operators import chunking as C
from ..operators import html as H
from ..operators import provenance as P
from ..operators import retrieval as R
from ..operators.postings import sent
from ..operators.ranked import best_shared
from ..session import spread, table, written

FOLD = "replace(translate(lower({}), 'ſςµ', 'sσμ'), 'ß', 'ss')"
COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def _query_vector(spark, d, vec_id=0):
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def vector_topk(spark, d):
    """T2, M1."""
    top = R.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 20)
    return top.select("vec_id", F.round("similarity", 6).alias("similarity"))


VECTOR_TOPK = f"SELECT e.vec_id, round({COS.format('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS.format('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 20"


def vector_topk_filtered(spark, d):
    """A label filter and a similarity floor."""
    top = R.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d, 1), 50, floor=0.05, where=F.col("label") == 1)
    return top.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


VECTOR_TOPK_FILTERED = f"SELECT vec_id, label, round(s, 6) AS similarity FROM (SELECT e.vec_id, e.label, {COS.format('e.embedding', 'q.embedding')} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE e.label = 1) WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 50"


def similarity_scales(spark, d):
    """M1, M2: each vector's similarity with the first one, on both scales."""
    q = V.constant(_query_vector(spark, d))
    c = V.cosine(F.col("embedding"), q)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.unit_similarity(c), 6).alias("full"), F.round(V.lite_similarity(c), 6).alias("lite"))


SIMILARITY_SCALES = f"SELECT vec_id, round((s + 1) / 2, 6) AS \"full\", round(s, 6) AS lite FROM (SELECT e.vec_id, {COS.format('e.embedding', 'q.embedding')} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def lexical_multiset_score(spark, d):
    """The five best documents of each benchmark item."""
    s = R.lexical_scores(table(spark, d, "benchmark"), spread(table(spark, d, "documents").select("doc_id", "text")), ("item_id", "text"), ("doc_id", "text"), top=5)
    return R.best_per(s, ["item_id"], [F.desc("lexical"), F.col("doc_id")], 5).select("item_id", "rank", "doc_id", F.round("lexical", 6).alias("lexical"))


_TOKENS = f"SELECT {{key}}, t AS token, count(*) AS n FROM (SELECT {{key}}, unnest(list_filter(regexp_extract_all({FOLD.format('text')}, '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{N}}}}_.-]+'), lambda x: length(x) >= 2)) AS t FROM {{tab}}) GROUP BY ALL"
_LEXICAL = f"q AS ({_TOKENS.format(key='item_id', tab='benchmark')}), d AS ({_TOKENS.format(key='doc_id', tab='documents')}), total AS (SELECT item_id, sum(n) AS total FROM q GROUP BY 1), lex AS (SELECT item_id, doc_id, sum(least(q.n, d.n)) / CAST(any_value(total) AS DOUBLE) AS lexical FROM q JOIN d USING (token) JOIN total USING (item_id) GROUP BY 1, 2)"
LEXICAL_MULTISET_SCORE = f"WITH {_LEXICAL}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY lexical DESC, doc_id) AS rank FROM lex) SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(lexical, 6) AS lexical FROM r WHERE rank <= 5"


def lexical_overlap_topk(spark, d):
    """The three best documents of each benchmark item by set recall."""
    s = R.overlap_scores(table(spark, d, "benchmark"), spread(table(spark, d, "documents").select("doc_id", "text")), ("item_id", "text"), ("doc_id", "text"), top=3)
    return R.best_per(s, ["item_id"], [F.desc("overlap"), F.col("doc_id")], 3).select("item_id", "rank", "doc_id", F.round("overlap", 6).alias("overlap"))


_TERMS = f"SELECT DISTINCT {{key}}, {FOLD.format('w')} AS term FROM (SELECT {{key}}, unnest(list_filter(string_split_regex(trim(replace(text, '\"', ' ')), '\\s+'), lambda x: length(x) > 2)) AS w FROM {{tab}})"
LEXICAL_OVERLAP_TOPK = f"WITH q AS ({_TERMS.format(key='item_id', tab='benchmark')}), d AS ({_TERMS.format(key='doc_id', tab='documents')}), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), s AS (SELECT item_id, doc_id, count(*) / CAST(any_value(n) AS DOUBLE) AS overlap FROM q JOIN d USING (term) JOIN n USING (item_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM s) SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, round(overlap, 6) AS overlap FROM r WHERE rank <= 3"


def lexical_walk(spark, d):
    """The ten best documents of each benchmark item, by postings walked from an item's rarest term on, for any number of items."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    words = X.word_tokens(F.col("text"))
    s = best_shared(table(spark, d, "benchmark"), docs, ("item_id", words), ("doc_id", words), 10)
    return R.best_per(s, ["item_id"], [F.desc("score"), F.col("doc_id")], 10).select("item_id", "rank", "doc_id", F.round("score", 6).alias("lexical"))


LEXICAL_WALK = LEXICAL_MULTISET_SCORE.replace("rank <= 5", "rank <= 10")


def classification_interleave(spark, d):
    """Twenty (claim, passage) tasks, interleaved by rank over the claims."""
    s = R.lexical_scores(table(spark, d, "benchmark"), spread(table(spark, d, "documents").select("doc_id", "text")), ("item_id", "text"), ("doc_id", "text"), top=20)
    return R.interleaved(s, [], "item_id", "doc_id", F.col("lexical") * 0.65 + 0.09, 20).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


CLASSIFICATION_INTERLEAVE = f"WITH {_LEXICAL}, r AS (SELECT *, lexical * CAST(0.65 AS DOUBLE) + CAST(0.09 AS DOUBLE) AS score FROM lex), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k ORDER BY k.rank, item_id LIMIT 20"


def _candidates(spark, d, **of_text):
    """Lexical and vector shortlists of each benchmark item, with all signals of T5. Neither list gates the other; a row of
    the lexical list alone has no similarity. of_text: columns of a document's own, made before it meets its claims."""
    b, docs, e = (table(spark, d, t) for t in ("benchmark", "documents", "embeddings"))
    claims = b.select("item_id", F.col("text").alias("claim"), X.exact_needles(F.col("text")).alias("needles"))
    cv = b.select("item_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qv")), "item_id")
    dv = docs.select("doc_id").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    vec = R.vector_shortlists(cv, dv, ("item_id", "qv"), ("doc_id", "embedding"), 200)
    vec = vec.select("item_id", "doc_id", V.unit_similarity(F.col("similarity")).alias("similarity")).persist()
    # one pass over the documents: the best of each item by tokens, and the words of what is near by vector
    scores = R.lexical_scores(b, spread(docs.select("doc_id", "text")), ("item_id", "text"), ("doc_id", "text"), 200, vec.select("item_id", "doc_id")).persist()
    lex = R.best_per(scores.where("lexical > 0"), ["item_id"], [F.desc("lexical"), F.col("doc_id")], 200).select("item_id", "doc_id", "lexical")
    vec = vec.join(scores, ["item_id", "doc_id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    # candidates travel to the texts, up to a measured size: no text but theirs is folded, and none is shuffled
    both = sent(R.union_candidates(vec, lex, ["item_id", "doc_id"]))
    texts = spread(docs.select("doc_id", "text", "source")).join(sent(both.select("doc_id").distinct()), "doc_id", "left_semi")
    own = texts.withColumns({"folded": X.fold(F.col("text")), **of_text})
    j = own.join(both, "doc_id").join(claims, "item_id")
    role = F.when(F.col("source") == "src0", "PRIMARY").when(F.col("source") == "src1", "OPINION").otherwise("SECONDARY_REPORT")
    return j.select(
        "item_id", "doc_id", "lexical", X.needles_found(F.col("needles"), F.col("folded")).alias("exact"), F.lit(0.5).alias("metadata"), X.source_role_score(role).alias("role"),
        F.least(F.lit(1.0), F.length("text") / F.lit(2000.0)).alias("certainty"), "similarity", "text", "claim", *of_text,
    )


def hybrid_rank(spark, d):
    """The twenty best passages of each claim."""
    return R.hybrid_rank(_candidates(spark, d), "item_id", "doc_id", 20).select("item_id", "rank", "doc_id", "score")


def lite_hybrid_rank(spark, d):
    """The eight best chunks of each claim, near-duplicates suppressed."""
    c = _candidates(spark, d, hay=X.searchable_text(F.col("text")), hash=F.xxhash64("text"), text_terms=X.lite_terms(F.col("text"), 120))
    c = c.withColumn("terms", X.lite_terms(F.col("claim"))).withColumn("signals", X.exact_signals(F.col("claim")))
    lexical, boost = X.lite_lexical_score(F.col("terms"), F.array("claim"), F.col("signals"), F.col("hay")), X.exact_signal_boost(F.col("signals"), F.col("hay"))
    c = c.withColumn("lite", lexical).withColumn("boost", boost).withColumn("combined", R.lite_score(F.col("similarity"), F.col("lite"), F.lit(1.0), F.col("boost")))
    c = c.select("item_id", "doc_id", "combined", "lite", "boost", "similarity", "hash", "text_terms").persist()
    kept = R.greedy_distinct(c, ["item_id"], [F.desc("combined"), F.col("doc_id")], "doc_id", F.col("hash"), F.col("text_terms"), 8)
    return kept.join(c.select("item_id", "doc_id", F.round("combined", 4).alias("combined"), X.low_confidence(F.col("combined"), F.col("lite"), F.col("boost"), F.col("similarity")).alias("low_confidence")), ["item_id", "doc_id"])


def diverse_sources(spark, d):
    """Ten diverse documents of each language."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    priority = F.bround(F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)), 4)
    intents = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("primary"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("support"))).otherwise(F.array(F.lit("contradiction"), F.lit("context")))
    return R.select_diverse(docs, ["lang"], "doc_id", priority, F.col("source"), X.cluster_key(F.col("text"), F.lit(""), F.col("doc_id").cast("string")), intents, 10)


def text_signals(spark, d):
    """S13, S17 to S19, S26 over whole documents: how many of each."""
    t, s = F.col("text"), X.exact_signals(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(s["names"]).alias("names"), F.size(s["numbers"]).alias("numbers"), F.size(s["identifiers"]).alias("identifiers"), F.size(X.statistics(t)).alias("statistics"), F.size(X.quoted_spans(t)).alias("quotes"), X.is_syndicated(t).alias("syndicated"), X.mentions_error(t).alias("error"), F.size(X.significant_terms(t)).alias("terms"))


def extraction_quality(spark, d):
    """S34, S44, F11."""
    t = F.col("text")
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("lines", X.lines_of(t))
    return docs.select("doc_id", X.extraction_quality(t, 6, F.col("lines")).alias("quality"), X.token_estimate(t).alias("tokens"), X.acceptable(t, F.col("lines")).alias("acceptable"))


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')"
_NORMAL = f"array_to_string(list_transform({_LINES}, lambda x: regexp_replace(x, '[ \\t\\r\\f\\v]+', ' ', 'g')), chr(10))"
EXTRACTION_QUALITY = f"""SELECT doc_id, CASE WHEN len({_LINES}) = 0 THEN 0.0 ELSE round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(length(text) / 2000.0::DOUBLE, 1.0::DOUBLE) * 0.65::DOUBLE + len(list_distinct({_LINES})) / CAST(len({_LINES}) AS DOUBLE) * 0.35::DOUBLE)), 6) END AS quality,
CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, length({_NORMAL}) >= 200 AND NOT regexp_matches(lower(substr({_NORMAL}, 1, 1000)), 'enable javascript|access denied|verify you are human|subscribe to continue') AS acceptable FROM documents"""


def exact_duplicates(spark, d):
    """G4 (equal content), W3, S31: every text that more than one document has, its first and the number of them."""
    docs = table(spark, d, "documents").select("doc_id", I.sha256(F.col("text")).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_known")).where("copies > 1")


EXACT_DUPLICATES = "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_known FROM documents GROUP BY 1 HAVING count(*) > 1"


def stable_ids(spark, d):
    """S31, S32, S43, S45."""
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", I.uuid5(t).alias("passage_id"), I.claim_ref(F.col("item_id").cast("string"), X.canonical_text(t)).alias("claim_ref"), X.slug(t).alias("slug"), X.report_title(t).alias("title"))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CUT = f"CASE WHEN instr(reverse({_FLAT}[:95]), ' ') > 0 AND 95 - instr(reverse({_FLAT}[:95]), ' ') > 24 THEN {_FLAT}[:95 - instr(reverse({_FLAT}[:95]), ' ')] ELSE {_FLAT}[:95] END"
_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(text))"
STABLE_IDS = f"""SELECT item_id, {_SHA}[:8] || '-' || {_SHA}[9:12] || '-5' || {_SHA}[14:16] || '-' || '89ab'[(instr('0123456789abcdef', {_SHA}[17]) - 1) % 4 + 1] || {_SHA}[18:20] || '-' || {_SHA}[21:32] AS passage_id,
'claim-' || item_id || '-' || sha256({FOLD.format(_FLAT)})[:16] AS claim_ref, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '')[:80] AS slug, CASE WHEN length({_FLAT}) <= 96 THEN {_FLAT} ELSE regexp_replace({_CUT}, '[ ,;:—-]+$', '') || '…' END AS title FROM benchmark"""


def _dependencies(spark, d):
    docs = table(spark, d, "documents").withColumn("run", F.lit("corpus"))
    feats = P.features(spread(docs.select("run", "doc_id", "text")), "doc_id", "text").withColumn("content_hash", I.sha256(F.col("text")))
    feats = P.stored(feats.drop("text"))
    pairs = P.candidate_pairs(feats, ["run"], "doc_id", F.col("doc_id"))
    edges = P.first_edges(P.pair_edges(pairs, feats, ["run"], "doc_id"), ["run"])
    return docs.select("run", F.col("doc_id").cast("string").alias("ref"), "doc_id", "source"), edges


def dependency_edges(spark, d):
    """Typed edges between documents."""
    return _dependencies(spark, d)[1].select("parent", "child", "relationship", "confidence", "method")


def origin_clusters(spark, d):
    """Information origins with more than one document."""
    nodes, edges = _dependencies(spark, d)
    edges = written(edges, "edges")
    labels = P.components(nodes.select("run", "ref"), edges, ["run"])
    first = nodes.select("run", "ref", F.timestamp_seconds(F.col("doc_id")).alias("at"))
    return P.clusters(labels, edges, ["run"], first).where(F.size("members") > 1).select("cluster_id", F.array_join("members", "|").alias("members"), "representative", "origin_type")


def url_canonical(spark, d):
    """S22, S23, S48."""
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.canonical_url(u).alias("canonical"), U.source_url(u).alias("source_url"), U.host(u).alias("host"))


_NOFRAG = "regexp_replace(url, '#.*$', '')"
_PATHQ = "regexp_extract({}, '^[^:]+://[^/?]+([^?]*)', 1)".format(_NOFRAG)
_Q = "regexp_extract({}, '[?](.*)$', 1)".format(_NOFRAG)
_HOST = "lower(regexp_extract(url, '^[^:]+://([^/:?#]+)', 1))"
_PORT = "regexp_extract(url, '^[^:]+://[^/:?#]+:([0-9]+)', 1)"
_KEPT = f"array_to_string(list_sort(list_filter(string_split({_Q}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid', 'gclid', 'mc_cid', 'mc_eid'], lower(string_split(x, '=')[1])))), '&')"
URL_CANONICAL = f"""SELECT page_id,
lower(split_part(url, '://', 1)) || '://' || {_HOST} || CASE WHEN {_PORT} = '' OR {_PORT} = (CASE WHEN starts_with(url, 'https') THEN '443' ELSE '80' END) THEN '' ELSE ':' || {_PORT} END || CASE WHEN {_PATHQ} = '' THEN '/' ELSE {_PATHQ} END || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END AS canonical,
lower(split_part(url, '://', 1)) || '://' || {_HOST} || CASE WHEN {_PORT} IN ('', '80', '443') THEN '' ELSE ':' || {_PORT} END || CASE WHEN rtrim({_PATHQ}, '/') = '' THEN '/' ELSE rtrim({_PATHQ}, '/') END || CASE WHEN {_Q} = '' THEN '' ELSE '?' || {_Q} END AS source_url,
{_HOST} AS host FROM pages"""


def url_host_counts(spark, d):
    """Pages, distinct URLs and hosts by registered domain (the host's last two labels)."""
    p = table(spark, d, "pages").select("url", U.host(F.col("url")).alias("host"))
    return p.groupBy(F.element_at(U.domain_suffixes(F.col("host")), -2).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"), F.countDistinct("host").alias("hosts"))


URL_HOST_COUNTS = f"SELECT array_to_string(string_split(h, '.')[-2:], '.') AS domain, count(*) AS pages, count(DISTINCT url) AS urls, count(DISTINCT h) AS hosts FROM (SELECT url, {_HOST} AS h FROM pages) GROUP BY 1"


def html_documents(spark, d):
    """IO4, IO5, IO8, F12, S35: pages with status, parser, quality and sizes."""
    p = H.extract(spread(table(spark, d, "pages")))
    return p.select("page_id", "status", "parser", "quality", "doc.title", F.length("body").alias("body_length"), F.size("doc.links").alias("links"), F.size("doc.blocks").alias("blocks"))


def html_blocks(spark, d):
    """IO6: ordered blocks of pages."""
    p = H.parsed(spread(table(spark, d, "pages").select("page_id", "html", "url"))).select("page_id", "doc")
    return p.select("page_id", F.posexplode("doc.blocks").alias("block_no", "b")).select("page_id", "block_no", "b.kind", "b.text", F.array_join("b.heading_path", " > ").alias("heading_path"), "b.position")


def html_passages(spark, d):
    """IO6 into G1: passages of pages from their blocks."""
    p = H.parsed(spread(table(spark, d, "pages").select("page_id", "html", "url"))).select("page_id", "doc")
    blocks = F.transform("doc.blocks", lambda b: F.struct(b["kind"].alias("kind"), F.lit(None).cast("int").alias("level"), b["text"].alias("text"), F.lit(None).cast("array<string>").alias("cells"), b["speaker"].alias("speaker"), b["heading_path"].alias("heading_path")))
    return C.passages(p.select("page_id", blocks.alias("blocks")), "page_id", "blocks").select("page_id", "passage_id", "block_index", "part_index", "kind", "heading_path", "text_hash", F.length("text").alias("n_chars"))


def passages(spark, d):
    """Passages of documents."""
    return C.body_passages(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", "passage_id", "block_index", "part_index", "kind", "text_hash", F.length("text").alias("n_chars"), "repeated")


def lite_chunks(spark, d):
    """IO3, G3, S32, S42: chunks of documents read as Markdown."""
    docs = C.markdown_parsed(spread(table(spark, d, "documents").select("doc_id", "text")), "text").select("doc_id", "blocks")
    return C.lite_chunks(docs, "doc_id", "blocks").select("doc_id", "chunk_index", "char_start", "char_end", "units", "overlap", "content_hash", "citation_label")


def transcript_turns(spark, d):
    """S37."""
    return C.transcript_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "speaker", "text_hash")


TRANSCRIPT_TURNS = "SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '^([A-Z][\\p{L}\\p{M}\\p{N}_ .''-]{0,79}):\\s+(.+)$', 1), ''), upper(role[1]) || role[2:]) AS speaker, sha256(text) AS text_hash FROM conversations"


def claim_profiles(spark, d):
    """Subject, place, year and focus of benchmark items as claims."""
    none = F.array().cast("array<string>")
    c = table(spark, d, "benchmark").select(F.lit("r").alias("run_id"), F.col("item_id").alias("claim_no"), F.col("item_id").cast("string").alias("claim_ref"), "text", F.lit("factual").alias("claim_kind"), F.lit("text").alias("input_kind"), none.alias("entities"), none.alias("locations"), none.alias("metrics"), F.lit(None).cast("string").alias("time_period"))
    return AU.profiles(c).select("claim_ref", "subject", "jurisdiction", "year", "focus")


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, similarity_scales, lexical_multiset_score, lexical_overlap_topk, lexical_walk, classification_interleave, hybrid_rank, lite_hybrid_rank, diverse_sources, text_signals, extraction_quality, exact_duplicates, stable_ids, dependency_edges, origin_clusters, url_canonical, url_host_counts, html_documents, html_blocks, html_passages, passages, lite_chunks, transcript_turns, claim_profiles)}
ORACLES = {
    "vector_topk": VECTOR_TOPK, "vector_topk_filtered": VECTOR_TOPK_FILTERED, "similarity_scales": SIMILARITY_SCALES, "lexical_multiset_score": LEXICAL_MULTISET_SCORE, "lexical_overlap_topk": LEXICAL_OVERLAP_TOPK, "lexical_walk": LEXICAL_WALK,
    "classification_interleave": CLASSIFICATION_INTERLEAVE, "extraction_quality": EXTRACTION_QUALITY, "exact_duplicates": EXACT_DUPLICATES, "url_canonical": URL_CANONICAL, "url_host_counts": URL_HOST_COUNTS, "transcript_turns": TRANSCRIPT_TURNS, "stable_ids": STABLE_IDS,
}
