"""One query per operator of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.catalog.bindings import MERGES, MIN_COUNT, PAIRS, SCORE_BITS, SEED, SOURCE, TARGETS, UNSEEN_SCORE, VOCAB_SIZE, Tables
from lexigraft.functions.vectors import l1_norm
from lexigraft.operators import merge_learning
from lexigraft.operators.assembly import union_branches
from lexigraft.operators.combination import combine_vectors
from lexigraft.operators.cooccurrence import name_pairs, ppmi
from lexigraft.operators.lookup import flag_membership, with_source_vectors
from lexigraft.operators.overlap import match_tokens, multi_source, new_tokens_exact, vocab_view
from lexigraft.operators.segmentation import count_tokens, join_tokens, segment_words, tokenize_corpus, with_min_count
from lexigraft.operators.similarity import cosine_summary, nearest
from lexigraft.operators.statistics import dimension_stats
from lexigraft.operators.vocab_forms import canonical_vocab, flag_symbols, vocab_family, with_decoded
from lexigraft.plans import checks
from lexigraft.plans.auxiliary import DIM, load_auxiliary, token_pairs
from lexigraft.plans.transfer import transfer, transfer_parts
from lexigraft.session import materialize, per_name, scratch_path
from lexigraft.sources import cache, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALL_RULES = {"match_symbols": True, "exact_match_all": True, "fuzzy_match_all": True}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def r6(c: Column) -> Column:
    # Adding zero turns -0.0 into 0.0.
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def entries(df: DataFrame, *keys: str) -> DataFrame:
    """Vectors as rows ``(*keys, pos, value)``."""
    return df.select(*keys, F.posexplode("vector").alias("pos", "value")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), r6(F.col("value")).alias("value")
    )


def overlap_columns(df: DataFrame) -> DataFrame:
    return df.select("pair_id", "id", "token", "match_kind", "src_id", "src_token", "n_sources")


# Sources, sinks, cache


@query
def scan_text(t: Tables) -> DataFrame:
    """Lines of all documents, written as a text file and read back."""
    path = scratch_path(t.spark, "lines") + ".txt"
    t.read("documents").select(F.explode(F.split("text", "\r\n|\r|\n")).alias("line")).write.text(path)
    return tables.read_corpus(t.spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query
def scan_jsonl(t: Tables) -> DataFrame:
    """All documents, written as JSON lines and read back."""
    path = scratch_path(t.spark, "samples") + ".jsonl"
    t.read("documents").select("text", "lang").write.json(path)
    return tables.read_corpus(t.spark, path)


@query
def scan_vocab(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "vocab")
    t.vocabs.select("vocab", "token", "id", "decoded", "is_special").write.parquet(path)
    vocab = tables.read_vocab(t.spark, path)
    doubled = tables.duplicate_entries(vocab).groupBy("vocab").agg(F.count("*").alias("n"))
    return vocab.join(doubled, "vocab", "left").select(
        "vocab", "token", "id", "decoded", "is_special", F.coalesce("n", F.lit(0)).alias("n_duplicates")
    )


@query
def scan_embeddings(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "embeddings")
    t.embeddings.write.parquet(path)
    return entries(tables.read_embeddings(t.spark, path), "matrix", "id")


# Roles that a map gives the learned special tokens, and whether it writes the token itself.
SPECIAL_ROLES = [
    ("bos_token", "<s>", True),
    ("cls_token", "<s>", False),
    ("eos_token", "</s>", False),
    ("sep_token", "</s>", True),
    ("unk_token", "<unk>", True),
    ("pad_token", "<pad>", True),
    ("mask_token", "<mask>", False),
]


def _special_maps(t: Tables) -> str:
    """Maps of the learned vocabularies as files. Further special tokens are the language's mark, which
    the vocabulary lacks, and the mark of word starts."""
    roles = t.spark.createDataFrame(SPECIAL_ROLES, "role string, token string, plain boolean")
    known = t.vocabs.where("is_special").join(per_name(roles), "token").select("vocab", "role", "token", "plain")
    marks = t.words.select(F.col("lang").alias("vocab")).distinct().select(
        "vocab",
        F.lit("additional_special_tokens").alias("role"),
        F.explode(F.array(F.concat(F.lit("<"), "vocab", F.lit(">")), F.lit("▁"))).alias("token"),
    )
    path = scratch_path(t.spark, "special_maps")
    sinks.write_special_maps(known.unionByName(marks.withColumn("plain", F.col("token") != "▁")), path)
    return f"{path}/*/*.txt"


def _named_by_folder(df: DataFrame) -> DataFrame:
    return df.withColumn("vocab", F.regexp_extract("vocab", "vocab=([^/]*)$", 1))


@query
def special_tokens(t: Tables) -> DataFrame:
    """Special tokens out of the vocabularies' maps, and the ids they have, as far as they are special there."""
    found = _named_by_folder(tables.read_special_tokens(t.spark, _special_maps(t)))
    return found.join(t.vocabs.where("is_special"), ["vocab", "token"]).select("vocab", "token", "id")


@query
def special_roles(t: Tables) -> DataFrame:
    """All roles of the vocabularies' maps, with the ids of the tokens that the vocabulary has."""
    found = _named_by_folder(tables.read_special_roles(t.spark, _special_maps(t)))
    return found.join(t.vocabs, ["vocab", "token"], "left").select("vocab", "role", "token", "id")


@query
def tokenized_sink(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tokenized")
    tokens = tokenize_corpus(t.corpus.select("lang", "text"), t.vocabs)
    sinks.write_tokenized(tokens, path, as_text=True)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def vocab_fingerprint(t: Tables) -> DataFrame:
    return cache.fingerprint(t.vocabs, ["token", "id"], ["vocab"])


@query
def cache_roundtrip(t: Tables) -> DataFrame:
    """Auxiliary vectors computed and stored by one call and loaded by the next."""
    root = scratch_path(t.spark, "cache")
    key = cache.cache_key("documents", t.target_corpus, t.target_vocab, dim=DIM, min_count=MIN_COUNT)
    _, found_first = cache.compute_or_load(t.spark, root, key, lambda: t.aux)
    again, found = cache.compute_or_load(t.spark, root, key, lambda: t.aux)
    return entries(again, "vocab", "token").withColumns(
        {"found_first": F.lit(found_first), "found": F.lit(found)}
    )


# Corpus text


@query
def tokenize(t: Tables) -> DataFrame:
    tokens = tokenize_corpus(t.corpus, t.vocabs)
    return tokens.select("doc_id", "lang", F.posexplode("tokens").alias("pos", "token")).select(
        "doc_id", "lang", F.col("pos").cast("bigint").alias("pos"), "token"
    )


QUERIES["tokenize_corpus"] = QUERIES.pop("tokenize")


def _tokens_of_family(t: Tables, vocab: DataFrame) -> DataFrame:
    """Tokens of all texts in the way the vocabularies' detected family writes words."""
    named = vocab.join(vocab_family(vocab.select("vocab", "token")), "vocab")
    tokens = tokenize_corpus(t.corpus, materialize(named, "named"))
    return tokens.select("doc_id", "lang", F.posexplode("tokens").alias("pos", "token")).select(
        "doc_id", "lang", F.col("pos").cast("bigint").alias("pos"), "token"
    )


@query
def tokenize_wordpiece(t: Tables) -> DataFrame:
    return _tokens_of_family(t, t.wordpiece_vocab)


@query
def tokenize_bytelevel(t: Tables) -> DataFrame:
    return _tokens_of_family(t, t.bpe_vocab)


@query
def tokenized_text(t: Tables) -> DataFrame:
    return join_tokens(tokenize_corpus(t.corpus, t.vocabs)).select("doc_id", "lang", "text")


@query
def token_min_count(t: Tables) -> DataFrame:
    return with_min_count(count_tokens(t.words, t.vocabs), MIN_COUNT)


@query
def learn_vocab(t: Tables) -> DataFrame:
    return t.vocabs.select("vocab", "token", "id", "decoded", "is_special")


@query
def learn_merges(t: Tables) -> DataFrame:
    """The first merges of every language, learned from all counted words."""
    return merge_learning.learn_merges(t.words, {lang: MERGES for lang in [SOURCE, *TARGETS]})


@query
def segment(t: Tables) -> DataFrame:
    cut = segment_words(t.words, t.vocabs)
    return cut.select("lang", "w", F.array_join("pieces", " ").alias("pieces"))


QUERIES["segment_words"] = QUERIES.pop("segment")


@query
def segment_scored(t: Tables) -> DataFrame:
    """The best-scored segmentation, with log frequencies of the pieces as scores, in steps whose sums are exact."""
    counts = count_tokens(t.words, t.vocabs)
    total = counts.groupBy("vocab").agg(F.sum("cnt").alias("total"))
    step = F.lit(float(1 << SCORE_BITS))
    score = F.floor(F.log(F.col("cnt") / F.col("total")) * step) / step
    scores = counts.join(per_name(total), "vocab").select("vocab", "token", score.alias("score"))
    vocab = materialize(
        t.vocabs.join(scores, ["vocab", "token"], "left").withColumn("score", F.coalesce("score", F.lit(UNSEEN_SCORE))),
        "scored",
    )
    cut = segment_words(t.words, vocab, method="score")
    return cut.select("lang", "w", F.array_join("pieces", " ").alias("pieces"))


# Vocabulary forms


@query
def vocab_families(t: Tables) -> DataFrame:
    """Families of the learned vocabularies of all three kinds."""
    kinds = [("sp", t.vocabs), ("wp", t.wordpiece_vocab), ("bpe", t.bpe_vocab)]
    named = [v.select(F.concat_ws(":", F.lit(k), "vocab").alias("vocab"), "token") for k, v in kinds]
    return vocab_family(named[0].unionByName(named[1]).unionByName(named[2]))


QUERIES["vocab_family"] = QUERIES.pop("vocab_families")


@query
def vocab_decoded(t: Tables) -> DataFrame:
    """Surface texts decoded from the tokens alone, for all three families."""
    out = None
    for kind, vocab in [("sp", t.vocabs), ("wp", t.wordpiece_vocab), ("bpe", t.bpe_vocab)]:
        decoded = with_decoded(vocab.drop("decoded")).select(F.lit(kind).alias("kind"), "vocab", "id", "token", "decoded")
        out = decoded if out is None else out.unionByName(decoded)
    return out


def _forms(vocab: DataFrame) -> DataFrame:
    return canonical_vocab(vocab).select("vocab", "token", "canonical", "bow")


@query
def canon_sentencepiece(t: Tables) -> DataFrame:
    return _forms(t.vocabs)


@query
def canon_byte_fallback(t: Tables) -> DataFrame:
    return _forms(t.byte_vocab)


@query
def canon_wordpiece(t: Tables) -> DataFrame:
    return _forms(t.wordpiece_vocab)


@query
def canon_bpe(t: Tables) -> DataFrame:
    return _forms(t.bpe_vocab)


@query
def token_forms(t: Tables) -> DataFrame:
    return canonical_vocab(t.vocabs).select("vocab", "id", "fuzzy", "uncased", "no_ws", "bow")


@query
def symbol_tokens(t: Tables) -> DataFrame:
    return flag_symbols(canonical_vocab(t.vocabs)).select("vocab", "id", "token", "fuzzy", "is_symbol")


@query
def canonical_vocabs(t: Tables) -> DataFrame:
    """Source and target vocabularies of every family, tagged by their role."""
    role = F.when(F.col("vocab") == SOURCE, "source").otherwise("target")
    out = None
    for kind, vocab in [("sp", t.vocabs), ("wp", t.wordpiece_vocab), ("bpe", t.bpe_vocab)]:
        forms = canonical_vocab(vocab).select(
            F.lit(kind).alias("kind"), role.alias("descriptor"), "vocab", "id", "token", "canonical", "fuzzy", "bow"
        )
        out = forms if out is None else out.unionByName(forms)
    return out


QUERIES["canonical_vocab"] = QUERIES.pop("canonical_vocabs")


@query
def view_exact(t: Tables) -> DataFrame:
    return vocab_view(materialize(canonical_vocab(t.bpe_vocab), "forms"), "canonical")


@query
def view_fuzzy(t: Tables) -> DataFrame:
    return vocab_view(materialize(canonical_vocab(t.vocabs), "forms"), "fuzzy")


# Overlap


@query
def overlap_default(t: Tables) -> DataFrame:
    return overlap_columns(match_tokens(t.target_forms, t.source_forms))


@query
def overlap_exact(t: Tables) -> DataFrame:
    return overlap_columns(match_tokens(t.target_forms, t.source_forms)).where(F.col("match_kind").isNotNull())


@query
def overlap_fuzzy(t: Tables) -> DataFrame:
    matched = match_tokens(t.target_forms, t.source_forms, exact_match_all=False, fuzzy_match_all=True)
    return overlap_columns(matched).where(F.col("match_kind").isNotNull())


@query
def overlap_symbols(t: Tables) -> DataFrame:
    matched = match_tokens(t.target_forms, t.source_forms, exact_match_all=False, match_symbols=True)
    return overlap_columns(matched).where(F.col("match_kind").isNotNull())


@query
def overlap_all_rules(t: Tables) -> DataFrame:
    return overlap_columns(match_tokens(t.target_forms, t.source_forms, **ALL_RULES))


@query
def new_tokens(t: Tables) -> DataFrame:
    return new_tokens_exact(t.target_forms, t.source_forms).select("pair_id", "id", "token")


@query
def overlap_sorted(t: Tables) -> DataFrame:
    matched = match_tokens(t.target_forms, t.source_forms).where(F.col("match_kind").isNotNull())
    return overlap_columns(matched).orderBy("pair_id", "id")


@query
def multi_source_tokens(t: Tables) -> DataFrame:
    forms = materialize(t.source_forms, "forms")
    found = multi_source(match_tokens(t.target_forms, forms, **ALL_RULES), forms)
    return found.select("pair_id", "id", "token", "n_sources", F.array_join("src_tokens", " ").alias("src_tokens"))


@query
def overlap_vectors(t: Tables) -> DataFrame:
    found = with_source_vectors(match_tokens(t.target_forms, t.source_forms), t.embeddings)
    return entries(found, "pair_id", "matrix", "id")


def _extended(t: Tables) -> DataFrame:
    from lexigraft.operators.overlap import with_pairs

    return with_pairs(canonical_vocab(t.extended_vocab), PAIRS)


@query
def extend_filter(t: Tables) -> DataFrame:
    matched = match_tokens(_extended(t), t.source_forms)
    flagged = flag_membership(matched.where(F.col("match_kind").isNotNull()), t.target_vocab)
    return flagged.select("pair_id", "id", "token", "in_extend")


@query
def rare_overlap(t: Tables) -> DataFrame:
    annotated = t.transfer_parts().annotated
    return annotated.where("outcome = 'copied'").select("pair_id", "id", "token", "use_for_init")


@query
def random_init_tokens(t: Tables) -> DataFrame:
    return checks.random_tokens(t.transfer_parts().annotated).select("pair_id", "id", "token")


# Auxiliary vectors


@query
def cooccurrence(t: Tables) -> DataFrame:
    pairs = token_pairs(t.target_corpus, t.target_vocab, MIN_COUNT, words=t.target_words)
    return name_pairs(pairs, t.target_vocab).select("lang", "token", "ctx", "n")


@query
def ppmi_weights(t: Tables) -> DataFrame:
    pairs = materialize(token_pairs(t.target_corpus, t.target_vocab, MIN_COUNT, words=t.target_words), "pairs")
    weighted = ppmi(name_pairs(pairs, t.target_vocab))
    return weighted.select("lang", "token", "ctx", r6(F.col("ppmi")).alias("ppmi")).where("ppmi > 0")


QUERIES["ppmi"] = QUERIES.pop("ppmi_weights")


@query
def aux_ppmi(t: Tables) -> DataFrame:
    return entries(t.aux, "vocab", "token")


@query
def aux_factorised(t: Tables) -> DataFrame:
    """Learned vectors of all frequent tokens of the target languages, at the library's default dimension."""
    vectors = load_auxiliary(t.target_vocab, corpus=t.target_corpus, reduction="factorise")
    return vectors.select("vocab", "token", F.posexplode("vector").alias("pos", "value"))


@query
def aux_from_table(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "aux")
    sinks.write_vectors(t.aux, path)
    chosen = load_auxiliary(table=tables.read_token_vectors(t.spark, path))
    return entries(chosen, "vocab", "token")


@query
def aux_words_scan(t: Tables) -> DataFrame:
    """Word vectors of two languages out of a table partitioned by language; the languages come from the pairs."""
    path = scratch_path(t.spark, "word_vectors")
    sinks.write_word_vectors(t.word_vectors, path)
    pairs = materialize(t.spark.createDataFrame(PAIRS, "pair_id string, source string, target string"), "pairs")
    languages = pairs.where(F.col("pair_id").isin("en-de", "en-es")).select(F.col("target").alias("lang"))
    return entries(tables.read_word_vectors(t.spark, path, languages), "lang", "word")


@query
def aux_wordlevel(t: Tables) -> DataFrame:
    vectors = load_auxiliary(
        t.target_vocab, "wordlevel", word_vectors=t.word_vectors, languages=TARGETS, dim=DIM
    )
    return entries(vectors, "vocab", "token")


@query
def aux_oov_ngrams(t: Tables) -> DataFrame:
    """Composed vectors of all corpus words without a word vector of their own."""
    from lexigraft.operators.wordlevel import compose_slices, ngram_vectors

    known = t.word_vectors
    unknown = t.target_words.select("lang", F.col("w").alias("word")).join(known, ["lang", "word"], "left_anti")
    found = entries(compose_slices(unknown, ngram_vectors(known, DIM), DIM), "lang", "word", "start")
    return found.select("lang", "word", (F.col("start") + F.col("pos")).alias("pos"), "value")


# Vectors


@query
def emb_mean(t: Tables) -> DataFrame:
    stats = dimension_stats(t.both_matrices)
    return stats.select("matrix", F.col("pos").cast("bigint").alias("pos"), r6(F.col("mean")).alias("value"))


@query
def emb_std(t: Tables) -> DataFrame:
    stats = dimension_stats(t.both_matrices)
    return stats.select("matrix", F.col("pos").cast("bigint").alias("pos"), r6(F.col("std")).alias("value"))


@query
def vector_l1(t: Tables) -> DataFrame:
    return t.embeddings.select("id", r6(l1_norm(F.col("vector"))).alias("value"))


@query
def cosine_pairs(t: Tables) -> DataFrame:
    found = cosine_summary(t.transfer_parts().annotated)
    return found.select(
        "pair_id",
        "id",
        "n_pairs",
        r6(F.col("z_sum")).alias("z_sum"),
        r6(F.col("z_min")).alias("z_min"),
        r6(F.col("z_max")).alias("z_max"),
    )


@query
def topk_neighbours(t: Tables) -> DataFrame:
    found = nearest(t.transfer_parts().annotated, 5)
    return found.select("pair_id", "id", "rank", "nbr_id", r6(F.col("z")).alias("z"))


@query
def sparsemax_weights(t: Tables) -> DataFrame:
    weights = t.transfer_parts().weights
    return weights.select("pair_id", "id", "nbr_id", "src_id", r6(F.col("w")).alias("w")).where("w > 0")


@query
def convex_combination(t: Tables) -> DataFrame:
    """Source vectors combined with the weights, before they become 32-bit."""
    parts = t.transfer_parts()
    return entries(combine_vectors(materialize(parts.weights, "weights"), t.embeddings, ["pair_id", "id"]), "pair_id", "id")


@query
def random_init(t: Tables) -> DataFrame:
    return entries(t.transfer_parts().random(), "pair_id", "matrix", "id")


@query
def copied_embeddings(t: Tables) -> DataFrame:
    result = with_source_vectors(match_tokens(t.target_forms, t.source_forms, **ALL_RULES), t.embeddings)
    return entries(result, "pair_id", "matrix", "id")


@query
def weighted_init(t: Tables) -> DataFrame:
    parts = t.transfer_parts(**ALL_RULES)
    return entries(union_branches(parts.weighted()), "pair_id", "matrix", "id")


# Transfers


def _transfer(t: Tables, embeddings: DataFrame | None = None, **options) -> DataFrame:
    target = options.pop("target_vocab", t.target_vocab)
    return transfer(
        t.source_vocab, target, t.embeddings if embeddings is None else embeddings, t.aux, PAIRS, seed=SEED, **options
    )


@query
def assembled_matrix(t: Tables) -> DataFrame:
    """Target matrices with ten rows more than the vocabularies have ids."""
    result = _transfer(t, target_sizes={p: VOCAB_SIZE + 10 for p, _, _ in PAIRS})
    return entries(result, "pair_id", "matrix", "id", "outcome")


@query
def transfer_full(t: Tables) -> DataFrame:
    return entries(_transfer(t), "pair_id", "matrix", "id", "token", "outcome")


@query
def transfer_extend(t: Tables) -> DataFrame:
    result = _transfer(t, target_vocab=t.extended_vocab, extend_vocab=t.target_vocab)
    return entries(result, "pair_id", "matrix", "id", "token", "outcome")


@query
def two_matrices(t: Tables) -> DataFrame:
    return entries(_transfer(t, t.both_matrices), "pair_id", "matrix", "id", "outcome")


@query
def multi_language(t: Tables) -> DataFrame:
    """All language pairs in one job, with word-level vectors and all match rules."""
    aux = load_auxiliary(t.target_vocab, "wordlevel", word_vectors=t.word_vectors, languages=TARGETS, dim=DIM)
    result = transfer(t.source_vocab, t.target_vocab, t.embeddings, aux, PAIRS, seed=SEED, **ALL_RULES)
    return entries(result, "pair_id", "matrix", "id", "outcome")


# Reports and checks


@query
def init_report(t: Tables) -> DataFrame:
    return checks.init_report(t.transfer_parts().annotated)


@query
def written_report(t: Tables) -> DataFrame:
    """Rows per pair and outcome, counted while the matrices are written."""
    counts = sinks.write_matrix(_transfer(t, t.both_matrices), scratch_path(t.spark, "matrices"), [p for p, _, _ in PAIRS])
    return t.spark.createDataFrame(counts, "pair_id string, outcome string, n bigint")


def _pairs(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(p, s) for p, s, _ in PAIRS], "pair_id string, source string")


@query
def check_reproducible(t: Tables) -> DataFrame:
    """Two complete runs under different numbers of shuffle partitions."""
    partitions = "spark.sql.shuffle.partitions"
    before = t.spark.conf.get(partitions)
    results = []
    try:
        for n in (3, 7):
            t.spark.conf.set(partitions, n)
            results.append(materialize(_transfer(Tables(t.spark, t.sf_dir)), "run"))
    finally:
        t.spark.conf.set(partitions, before)
    return checks.differing_rows(*results)


@query
def check_specials(t: Tables) -> DataFrame:
    # Special tokens whose vectors must stay.
    kept = ["<mask>", "</s>", "<pad>", "<s>"]
    return checks.specials_kept(_transfer(t), t.source_vocab, t.embeddings, _pairs(t), kept)


@query
def check_nonzero(t: Tables) -> DataFrame:
    return checks.nonzero_rows(_transfer(t))


@query
def check_overlap_copied(t: Tables) -> DataFrame:
    parts = t.transfer_parts()
    result = union_branches(parts.combined(), parts.random())
    return checks.overlap_copied(result, parts.annotated, t.embeddings)


@query
def check_extension_preserves(t: Tables) -> DataFrame:
    result = _transfer(t, target_vocab=t.extended_vocab, extend_vocab=t.target_vocab)
    return checks.extension_preserves(result, t.source_vocab, t.embeddings, _pairs(t))


@query
def check_convex(t: Tables) -> DataFrame:
    return checks.convex_weights(t.transfer_parts().weights)
