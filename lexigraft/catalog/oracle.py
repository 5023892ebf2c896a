"""The queries once more in SQL, each in its most literal form."""

from __future__ import annotations

import re

from lexigraft.catalog.bindings import MIN_COUNT, OTHER_VOCAB_SIZE, SCORE_BITS, SEED, TARGETS, UNSEEN_SCORE, VOCAB_SIZE
from lexigraft.functions.text import BYTE_PIECE, PUNCTUATION, SPACE, numeric_class
from lexigraft.plans.auxiliary import DIM

_TARGET_LIST = ", ".join(f"'{t}'" for t in TARGETS)
_LTRIM = f"'^{SPACE}+'"


def _r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _learned(name: str, sizes: str) -> dict[str, str]:
    """Vocabularies learned with the sizes of the relation ``sizes``."""
    return {
        name: f"""
            SELECT lang AS vocab, token, id, replace(token, '▁', ' ') AS decoded, g = 0 AS is_special, n
            FROM (
                SELECT p.*, row_number() OVER (PARTITION BY p.lang ORDER BY g, n DESC, token) - 1 AS id, s.size
                FROM (
                    SELECT lang, token, n, g FROM specials, (SELECT lang FROM {sizes})
                    UNION ALL SELECT lang, '▁', 0, 1 FROM {sizes}
                    UNION ALL SELECT lang, ch, n, 2 FROM chars
                    UNION ALL SELECT lang, '▁' || w, n, 3 FROM words
                ) p JOIN {sizes} s ON s.lang = p.lang
            ) WHERE id < size""",
    }


CTES: dict[str, str] = {
    "words": f"""
        SELECT lang, w, count(*) AS n
        FROM (SELECT lang, unnest(regexp_split_to_array(text, '{SPACE}+')) AS w FROM documents)
        WHERE w <> '' GROUP BY lang, w""",
    "chars": """
        SELECT lang, ch, sum(n)::BIGINT AS n
        FROM (SELECT lang, unnest(string_split(w, '')) AS ch, n FROM words)
        WHERE ch NOT IN ('', '▁') GROUP BY lang, ch""",
    "specials": """
        SELECT * FROM (VALUES ('<s>', 0, 0), ('<pad>', -1, 0), ('</s>', -2, 0), ('<unk>', -3, 0), ('<mask>', -4, 0))
        AS t(token, n, g)""",
    "sizes": f"""
        SELECT 'en' AS lang, count(*) AS size FROM embeddings
        UNION ALL SELECT unnest([{_TARGET_LIST}]), {VOCAB_SIZE}""",
    **_learned("vocabs", "sizes"),
    "word_pieces": f"""
        SELECT lang AS vocab, '▁' || w AS token, n FROM words WHERE lang IN ({_TARGET_LIST}) AND n >= {MIN_COUNT}""",
    "wp_vocab": f"""
        SELECT lang AS vocab, token, id, g = 0 AS is_special FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY g, n DESC, token) - 1 AS id FROM (
                SELECT lang, token, sum(n)::BIGINT AS n, 1 AS g FROM (
                    SELECT lang, w AS token, n FROM words
                    UNION ALL SELECT lang, '##' || right(w, 3), n FROM words WHERE length(w) > 3
                ) WHERE token NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]') GROUP BY lang, token
                UNION ALL
                SELECT lang, token, n, 0 FROM
                    (VALUES ('[PAD]', 0), ('[UNK]', -1), ('[CLS]', -2), ('[SEP]', -3), ('[MASK]', -4)) t(token, n),
                    (SELECT DISTINCT lang FROM words)
            )
        ) WHERE id < {OTHER_VOCAB_SIZE}""",
    "byte_chars": """
        SELECT b, CASE WHEN self THEN chr(b) ELSE chr(256 + (row_number() OVER (PARTITION BY self ORDER BY b))::INT - 1)
            END AS ch
        FROM (
            SELECT b::INT AS b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS self
            FROM range(256) t(b)
        )""",
    "word_bytes": """
        SELECT lang, w, n, i, ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::INT AS b
        FROM (SELECT lang, w, n, unnest(range(1, octet_length(encode(w)) + 1)) AS i FROM words)""",
    # The decoded text of every token is known from how the token was made.
    "bpe_vocab": f"""
        SELECT lang AS vocab, token, id, decoded, bow, g = 0 AS is_special FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY g, n DESC, token) - 1 AS id FROM (
                SELECT lang, token, n, g, token AS decoded, false AS bow FROM specials, (SELECT DISTINCT lang FROM words)
                UNION ALL
                SELECT lang, ch, sum(n)::BIGINT, 1, CASE WHEN b < 128 THEN chr(b) ELSE chr(65533) END, false
                FROM word_bytes JOIN byte_chars USING (b) GROUP BY lang, b, ch
                UNION ALL
                SELECT lang, CASE WHEN spaced THEN chr(288) || e ELSE e END, n, 2,
                    CASE WHEN spaced THEN ' ' || w ELSE w END, spaced
                FROM (
                    SELECT lang, w, any_value(n) AS n, string_agg(ch, '' ORDER BY i) AS e, count(*) AS n_bytes
                    FROM word_bytes JOIN byte_chars USING (b) GROUP BY lang, w
                ), (VALUES (true), (false)) s(spaced)
                WHERE spaced OR n_bytes > 1 AND e NOT IN ('<s>', '<pad>', '</s>', '<unk>', '<mask>')
            )
        ) WHERE id < {OTHER_VOCAB_SIZE}""",
    "byte_tokens": """
        SELECT DISTINCT lang AS vocab, printf('<0x%02X>', b) AS token FROM word_bytes""",
    "forms": f"""
        SELECT *, replace(canonical, '▁', '') AS no_ws, lower(canonical) AS uncased,
            lower(replace(canonical, '▁', '')) AS fuzzy
        FROM (
            SELECT vocab, id, token, is_special, starts_with(token, '▁') AS bow,
                CASE WHEN starts_with(token, '▁') THEN '▁' || regexp_replace(decoded, {_LTRIM}, '')
                     ELSE regexp_replace(decoded, {_LTRIM}, '') END AS canonical
            FROM vocabs
        )""",
    "extended": f"""
        SELECT t.vocab, s.id, s.token, s.is_special FROM vocabs s, (SELECT unnest([{_TARGET_LIST}]) AS vocab) t
        WHERE s.vocab = 'en'
        UNION ALL
        SELECT vocab, (SELECT max(id) + 1 FROM vocabs WHERE vocab = 'en')
            + row_number() OVER (PARTITION BY vocab ORDER BY id) - 1, token, is_special
        FROM vocabs WHERE vocab <> 'en' AND token NOT IN (SELECT token FROM vocabs WHERE vocab = 'en')""",
    "ext_forms": """
        SELECT e.vocab, e.id, e.token, f.canonical, f.fuzzy, f.is_special
        FROM extended e JOIN (SELECT DISTINCT token, canonical, fuzzy, is_special FROM forms) f USING (token)""",
    "src": "SELECT * FROM forms WHERE vocab = 'en'",
    "by_exact": """
        SELECT canonical, max(id) AS src_id, arg_max(token, id) AS src_token, count(*) AS n_sources
        FROM src GROUP BY canonical""",
    "by_fuzzy": """
        SELECT fuzzy, id AS src_id, token AS src_token, n_sources FROM (
            SELECT *, count(*) OVER (PARTITION BY fuzzy) AS n_sources, row_number() OVER (
                PARTITION BY fuzzy ORDER BY canonical <> fuzzy, CASE WHEN canonical = fuzzy THEN -id ELSE id END) AS rn
            FROM src
        ) WHERE rn = 1""",
    "flagged": f"""
        SELECT f.*, f.fuzzy IN (SELECT token FROM vocabs v WHERE v.is_special AND v.vocab = f.vocab)
            OR regexp_matches(fuzzy, '^{numeric_class()}+$')
            OR regexp_matches(fuzzy, '^{PUNCTUATION}*$')
            OR regexp_matches(fuzzy, '^{SPACE}+$') AS is_symbol
        FROM forms f""",
    # Words cut greedily: the longest piece at every position, then the walk.
    "piece_lengths": "SELECT DISTINCT vocab AS lang, length(token) AS len FROM vocabs WHERE NOT is_special",
    "target_words": f"SELECT lang, w, n FROM words WHERE lang IN ({_TARGET_LIST})",
    "spelled": "SELECT lang, w, n, '▁' || w AS m FROM words",
    "longest": """
        SELECT s.lang, s.w, s.i, max(s.len) AS len
        FROM (
            SELECT p.lang, p.w, p.i, l.len, substr(p.m, p.i, l.len) AS token
            FROM (SELECT lang, w, m, unnest(range(1, length(m) + 1)) AS i FROM spelled) p
            JOIN piece_lengths l ON l.lang = p.lang AND l.len <= length(p.m) - p.i + 1
        ) s JOIN vocabs v ON v.vocab = s.lang AND v.token = s.token AND NOT v.is_special
        GROUP BY s.lang, s.w, s.i""",
    "walk": """
        SELECT lang, w, m, 1::BIGINT AS i FROM spelled
        UNION ALL
        SELECT k.lang, k.w, k.m, k.i + coalesce(l.len, 1) FROM walk k
        LEFT JOIN longest l ON l.lang = k.lang AND l.w = k.w AND l.i = k.i
        WHERE k.i + coalesce(l.len, 1) <= length(k.m)""",
    "seg": """
        SELECT k.lang, k.w, k.i, CASE WHEN l.len IS NULL THEN '<unk>' ELSE substr(k.m, k.i, l.len) END AS token
        FROM walk k LEFT JOIN longest l ON l.lang = k.lang AND l.w = k.w AND l.i = k.i""",
    # The same over all languages for the other families: wordpiece, and byte level.
    "wp_longest": """
        SELECT s.lang, s.w, s.i, max(s.len) AS len
        FROM (
            SELECT p.lang, p.w, p.i, l.len,
                CASE WHEN p.i > 1 THEN '##' ELSE '' END || substr(p.w, p.i, l.len) AS token
            FROM (SELECT lang, w, unnest(range(1, length(w) + 1)) AS i FROM words) p
            JOIN (SELECT DISTINCT vocab AS lang, unnest([length(token), length(token) - 2]) AS len FROM wp_vocab
                  WHERE NOT is_special) l ON l.lang = p.lang AND l.len BETWEEN 1 AND length(p.w) - p.i + 1
        ) s JOIN wp_vocab v ON v.vocab = s.lang AND v.token = s.token AND NOT v.is_special
        GROUP BY s.lang, s.w, s.i""",
    "wp_walk": """
        SELECT lang, w, 1::BIGINT AS i FROM words
        UNION ALL
        SELECT k.lang, k.w, k.i + l.len FROM wp_walk k JOIN wp_longest l ON l.lang = k.lang AND l.w = k.w AND l.i = k.i
        WHERE k.i + l.len <= length(k.w)""",
    "wp_seg": """
        SELECT lang, w, CASE WHEN failed THEN 1 ELSE i END AS i, CASE WHEN failed THEN '[UNK]' ELSE token END AS token
        FROM (
            SELECT k.lang, k.w, k.i, CASE WHEN k.i > 1 THEN '##' ELSE '' END || substr(k.w, k.i, l.len) AS token,
                bool_or(l.len IS NULL) OVER (PARTITION BY k.lang, k.w) AS failed
            FROM wp_walk k LEFT JOIN wp_longest l ON l.lang = k.lang AND l.w = k.w AND l.i = k.i
        ) WHERE NOT failed OR i = 1""",
    "bl_words": """
        SELECT lang, w, chr(288) || string_agg(ch, '' ORDER BY i) AS m
        FROM word_bytes JOIN byte_chars USING (b) GROUP BY lang, w""",
    "bl_longest": """
        SELECT s.lang, s.w, s.i, max(s.len) AS len
        FROM (
            SELECT p.lang, p.w, p.i, l.len, substr(p.m, p.i, l.len) AS token
            FROM (SELECT lang, w, m, unnest(range(1, length(m) + 1)) AS i FROM bl_words) p
            JOIN (SELECT DISTINCT vocab AS lang, length(token) AS len FROM bpe_vocab WHERE NOT is_special) l
                ON l.lang = p.lang AND l.len <= length(p.m) - p.i + 1
        ) s JOIN bpe_vocab v ON v.vocab = s.lang AND v.token = s.token AND NOT v.is_special
        GROUP BY s.lang, s.w, s.i""",
    "bl_walk": """
        SELECT lang, w, m, 1::BIGINT AS i FROM bl_words
        UNION ALL
        SELECT k.lang, k.w, k.m, k.i + coalesce(l.len, 1) FROM bl_walk k
        LEFT JOIN bl_longest l ON l.lang = k.lang AND l.w = k.w AND l.i = k.i
        WHERE k.i + coalesce(l.len, 1) <= length(k.m)""",
    "bl_seg": """
        SELECT k.lang, k.w, k.i, CASE WHEN l.len IS NULL THEN '<unk>' ELSE substr(k.m, k.i, l.len) END AS token
        FROM bl_walk k LEFT JOIN bl_longest l ON l.lang = k.lang AND l.w = k.w AND l.i = k.i""",
    "all_doc_words": f"""
        SELECT doc_id, lang, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS at
        FROM (
            SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS l
            FROM documents
        )""",
    "doc_words": f"""
        SELECT doc_id, lang, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS at
        FROM (
            SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS l
            FROM documents WHERE lang IN ({_TARGET_LIST})
        )""",
    "tokens": """
        SELECT d.doc_id, d.lang, s.token, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.at, s.i) - 1 AS pos
        FROM doc_words d JOIN seg s ON s.lang = d.lang AND s.w = d.w""",
    "all_tokens": """
        SELECT d.doc_id, d.lang, s.token, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.at, s.i) - 1 AS pos
        FROM all_doc_words d JOIN seg s ON s.lang = d.lang AND s.w = d.w""",
    "token_texts": """
        SELECT c.doc_id, c.lang, coalesce(t.text, '') AS text
        FROM (SELECT doc_id, lang FROM documents) c
        LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM all_tokens GROUP BY doc_id) t
            ON t.doc_id = c.doc_id""",
    # Word counts times pieces, as the words are cut once each.
    "piece_counts": """
        SELECT s.lang AS vocab, s.token, sum(w.n)::BIGINT AS cnt FROM seg s JOIN words w USING (lang, w) GROUP BY s.lang, s.token""",
    "scored": f"""
        SELECT v.vocab AS lang, v.token, coalesce(floor(ln(c.cnt / c.total) * {1 << SCORE_BITS}) / {1 << SCORE_BITS}, {UNSEEN_SCORE}) AS score
        FROM vocabs v LEFT JOIN (SELECT *, sum(cnt) OVER (PARTITION BY vocab)::DOUBLE AS total FROM piece_counts) c
            ON c.vocab = v.vocab AND c.token = v.token
        WHERE NOT v.is_special""",
    # All pieces that end at a place of a word.
    "arcs": """
        SELECT s.lang, s.w, s.i + s.len - 1 AS stop, list({'start': s.i - 1, 'score': v.score}) AS options, bool_or(s.len = 1) AS single
        FROM (
            SELECT p.lang, p.w, p.i, l.len, substr(p.m, p.i, l.len) AS token
            FROM (SELECT lang, w, m, unnest(range(1, length(m) + 1)) AS i FROM spelled) p
            JOIN piece_lengths l ON l.lang = p.lang AND l.len <= length(p.m) - p.i + 1
        ) s JOIN scored v ON v.lang = s.lang AND v.token = s.token
        GROUP BY s.lang, s.w, s.i + s.len - 1""",
    "unknown_scores": "SELECT lang, min(score) - 10 AS unknown FROM scored GROUP BY lang",
    # Best sums and cuts of all beginnings of a word; of equal sums the one with the longer last piece.
    "best_walk": """
        SELECT lang, w, m, 0::BIGINT AS i, [0.0::DOUBLE] AS sums, [''] AS cuts FROM spelled
        UNION ALL
        SELECT lang, w, m, i + 1, list_append(sums, best.v), list_append(cuts, cuts[1 - best.t] || ' ' ||
            CASE WHEN best.known THEN substr(m, 1 - best.t, i + 1 + best.t) ELSE '<unk>' END)
        FROM (
            SELECT k.*, list_sort([{'v': k.sums[o.start + 1] + o.score, 't': -o.start, 'known': true} FOR o IN coalesce(a.options, [])]
                || CASE WHEN coalesce(a.single, false) THEN [] ELSE [{'v': k.sums[k.i + 1] + u.unknown, 't': -k.i, 'known': false}] END,
                'DESC')[1] AS best
            FROM best_walk k JOIN unknown_scores u ON u.lang = k.lang
            LEFT JOIN arcs a ON a.lang = k.lang AND a.w = k.w AND a.stop = k.i + 1
            WHERE k.i < length(k.m)
        )""",
    "token_counts": f"""
        SELECT lang AS vocab, token, count(*) AS cnt FROM tokens GROUP BY lang, token HAVING count(*) >= {MIN_COUNT}""",
    "kept": """
        SELECT t.doc_id, t.lang, t.token, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.pos) AS pos
        FROM tokens t JOIN token_counts c ON c.vocab = t.lang AND c.token = t.token""",
    "kept_words": f"""
        SELECT d.doc_id, d.lang, d.w AS token, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.at) AS pos
        FROM doc_words d JOIN word_pieces p
            ON p.vocab = d.lang AND p.token = '▁' || d.w AND p.n >= {MIN_COUNT}""",
    "emb": """
        SELECT vec_id AS src_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings""",
    "emb2": """
        SELECT 'input' AS matrix, src_id, pos, x FROM emb
        UNION ALL SELECT 'output', src_id, max(pos) OVER (PARTITION BY src_id) - pos, x FROM emb""",
    "stats": """
        SELECT matrix, pos, avg(x) AS mean, stddev_samp(x) AS std FROM emb2 GROUP BY matrix, pos""",
}


def _vectors(prefix: str, kept: str, mark: str) -> dict[str, str]:
    """Pairs, PPMI and projected vectors over the relation ``kept``. ``mark`` is put
    before the context for the signs."""
    return {
        f"{prefix}pairs": f"""
            SELECT a.lang, a.token, b.token AS ctx, count(*) AS n
            FROM (SELECT *, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM {kept}) a
            JOIN {kept} b ON b.doc_id = a.doc_id AND b.pos = a.pos + a.d
            GROUP BY a.lang, a.token, b.token""",
        f"{prefix}ppmi": f"""
            SELECT lang, token, ctx, greatest(0.0, ln((n::DOUBLE * n_all) / (n_token::DOUBLE * n_ctx))) AS ppmi FROM (
                SELECT *, sum(n) OVER (PARTITION BY lang, token)::DOUBLE AS n_token,
                    sum(n) OVER (PARTITION BY lang, ctx)::DOUBLE AS n_ctx,
                    sum(n) OVER (PARTITION BY lang)::DOUBLE AS n_all
                FROM {prefix}pairs
            )""",
        f"{prefix}signs": f"""
            SELECT lang, ctx, j,
                1 - 2 * (((instr('0123456789abcdef', substr(md5('{mark}' || ctx), 1 + j // 4, 1)) - 1) >> (j % 4)) & 1) AS s
            FROM (SELECT DISTINCT lang, ctx FROM {prefix}pairs), range({DIM}) r(j)""",
        f"{prefix}vectors": f"""
            SELECT p.lang AS vocab, p.token, j AS pos,
                sum(round(ppmi * 1073741824)::BIGINT * s)::DOUBLE / 1073741824 / sqrt({DIM}.0) AS value
            FROM {prefix}ppmi p JOIN {prefix}signs s ON s.lang = p.lang AND s.ctx = p.ctx
            WHERE ppmi > 0 GROUP BY p.lang, p.token, j""",
    }


CTES |= _vectors("t_", "kept", "")
CTES |= _vectors("w_", "kept_words", "▁")


def _composed(prefix: str, words: str) -> dict[str, str]:
    """Vectors composed of n-grams for the relation ``words(lang, w)``."""
    return {
        f"{prefix}grams": f"""
            SELECT lang, w, substr('<' || w || '>', i, k) AS g
            FROM (
                SELECT lang, w, k, unnest(range(1, length(w) + 2 - k + 2)) AS i FROM {words}, range(3, 7) t(k)
                WHERE length(w) + 2 >= k
            )""",
        f"{prefix}composed": f"""
            SELECT o.lang, o.w, g.pos, sum(round(g.value * 1073741824)::BIGINT)::DOUBLE / 1073741824 / count(*) AS value
            FROM {prefix}grams o JOIN gram_vectors g ON g.lang = o.lang AND g.g = o.g GROUP BY o.lang, o.w, g.pos""",
    }


CTES |= {
    "known_words": "SELECT DISTINCT vocab AS lang, token AS w FROM w_vectors",
    "known_grams": """
        SELECT lang, w, substr('<' || w || '>', i, k) AS g
        FROM (
            SELECT lang, w, k, unnest(range(1, length(w) + 2 - k + 2)) AS i FROM known_words, range(3, 7) t(k)
            WHERE length(w) + 2 >= k
        )""",
    "gram_vectors": """
        SELECT g.lang, g.g, v.pos, sum(round(v.value * 1073741824)::BIGINT)::DOUBLE / 1073741824 / count(*) AS value
        FROM known_grams g JOIN w_vectors v ON v.vocab = g.lang AND v.token = g.w GROUP BY g.lang, g.g, v.pos""",
    "oov_words": """
        SELECT lang, w FROM target_words ANTI JOIN known_words USING (lang, w)""",
    **_composed("oov_", "oov_words"),
    "clean": f"""
        SELECT vocab, token, regexp_replace(decoded, '^{SPACE}+|{SPACE}+$', '', 'g') AS w FROM vocabs WHERE vocab <> 'en'""",
    "oov_tokens": """
        SELECT DISTINCT vocab AS lang, w FROM clean c
        WHERE NOT EXISTS (FROM known_words k WHERE k.lang = c.vocab AND k.w = c.w)""",
    **_composed("tok_", "oov_tokens"),
    "wordlevel": f"""
        SELECT c.vocab, c.token, j AS pos, coalesce(v.value, 0.0) AS value
        FROM (SELECT * FROM clean, range({DIM}) r(j)) c
        LEFT JOIN (
            SELECT vocab, token AS w, pos, value FROM w_vectors
            UNION ALL SELECT lang, w, pos, value FROM tok_composed
        ) v ON v.vocab = c.vocab AND v.w = c.w AND v.pos = c.j""",
}


def _matched(name: str, target: str, exact: bool, fuzzy: bool, symbols: bool) -> dict[str, str]:
    rule = f"""
        CASE WHEN {symbols} AND f.is_symbol AND coalesce(e.src_id, z.src_id) IS NOT NULL THEN 'numerical_symbol'
             WHEN {exact} AND e.src_id IS NOT NULL THEN 'exact_match'
             WHEN {fuzzy} AND z.src_id IS NOT NULL THEN 'fuzzy_match' END"""
    use_exact = "match_kind = 'exact_match' OR match_kind = 'numerical_symbol' AND e_id IS NOT NULL"
    symbol_column = "f.is_symbol" if symbols else "false"
    return {
        name: f"""
            SELECT 'en-' || vocab AS pair_id, vocab, id, token, match_kind, canonical, fuzzy,
                CASE WHEN {use_exact} THEN e_id WHEN match_kind IS NOT NULL THEN z_id END AS src_id,
                CASE WHEN {use_exact} THEN e_token WHEN match_kind IS NOT NULL THEN z_token END AS src_token,
                CASE WHEN {use_exact} THEN e_n WHEN match_kind IS NOT NULL THEN z_n END AS n_sources,
                ({use_exact}) AS by_canonical
            FROM (
                SELECT f.*, {rule.replace('f.is_symbol', symbol_column)} AS match_kind, e.src_id AS e_id, e.src_token AS e_token,
                    e.n_sources AS e_n, z.src_id AS z_id, z.src_token AS z_token, z.n_sources AS z_n
                FROM {target} f LEFT JOIN by_exact e ON e.canonical = f.canonical
                LEFT JOIN by_fuzzy z ON z.fuzzy = f.fuzzy
                WHERE f.vocab <> 'en'
            )""",
    }


CTES |= _matched("m_default", "forms", True, False, False)
CTES |= _matched("m_fuzzy", "forms", False, True, False)
CTES |= _matched("m_symbols", "flagged", False, False, True)
CTES |= _matched("m_all", "flagged", True, True, True)
CTES |= _matched("m_ext", "ext_forms", True, False, False)


def _transferred(prefix: str, matched: str, aux: str, member: str = "true", matrices: str = "'input'") -> dict[str, str]:
    """Annotated tokens, weights and the three branches of a transfer."""
    return {
        f"{prefix}aux": f"""
            SELECT vocab, token, list(value ORDER BY pos) AS v, sum(abs(value)) > 0 AS usable
            FROM {aux} GROUP BY vocab, token""",
        f"{prefix}ann": f"""
            SELECT m.*, a.v, coalesce(a.usable, false) AS usable,
                m.match_kind IS NOT NULL AND {member} AND coalesce(a.usable, false) AS use_for_init,
                CASE WHEN m.match_kind IS NOT NULL THEN 'copied' WHEN a.usable THEN 'weighted' ELSE 'random' END AS outcome
            FROM {matched} m LEFT JOIN {prefix}aux a ON a.vocab = m.vocab AND a.token = m.token""",
        f"{prefix}z": f"""
            SELECT n.pair_id, n.id, n.token, o.id AS nbr_id, o.src_id,
                list_dot_product(n.v, o.v) / (sqrt(list_dot_product(n.v, n.v)) * sqrt(list_dot_product(o.v, o.v))) AS z
            FROM {prefix}ann n JOIN {prefix}ann o ON o.pair_id = n.pair_id
            WHERE n.outcome = 'weighted' AND o.use_for_init""",
        f"{prefix}w": f"""
            SELECT pair_id, id, token, nbr_id, src_id, z - tau AS w FROM (
                SELECT *, max(CASE WHEN 1 + k * z > total THEN k END) OVER (PARTITION BY pair_id, id) AS size,
                    arg_max((total - 1) / k, CASE WHEN 1 + k * z > total THEN k END) OVER (PARTITION BY pair_id, id) AS tau
                FROM (
                    SELECT *, row_number() OVER best AS k,
                        sum(z) OVER (best ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
                    FROM {prefix}z WINDOW best AS (PARTITION BY pair_id, id ORDER BY z DESC, nbr_id)
                )
            ) WHERE z > tau""",
        f"{prefix}copied": f"""
            SELECT a.pair_id, e.matrix, a.id, a.token, a.outcome, e.pos, e.x AS value
            FROM {prefix}ann a JOIN emb2 e ON e.src_id = a.src_id
            WHERE a.outcome = 'copied' AND e.matrix IN ({matrices})""",
        f"{prefix}weighted": f"""
            SELECT w.pair_id, e.matrix, w.id, w.token, 'weighted' AS outcome, e.pos, sum(w.w * e.x) AS value
            FROM {prefix}w w JOIN emb2 e ON e.src_id = w.src_id WHERE e.matrix IN ({matrices})
            GROUP BY w.pair_id, e.matrix, w.id, w.token, e.pos""",
        f"{prefix}random": f"""
            SELECT pair_id, matrix, id, token, outcome, pos, mean + std * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS value
            FROM (
                SELECT *, (('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u1,
                    ('0x' || substr(h, 17, 13))::BIGINT::DOUBLE / 4503599627370496 AS u2
                FROM (
                    SELECT a.*, s.matrix, s.pos, s.mean, s.std, md5('{SEED}:' || a.id || ':' || s.pos) AS h
                    FROM {prefix}ann a, stats s WHERE a.outcome = 'random' AND s.matrix IN ({matrices})
                )
            )""",
        f"{prefix}all": f"""
            SELECT * FROM {prefix}copied UNION ALL SELECT * FROM {prefix}weighted UNION ALL SELECT * FROM {prefix}random""",
        f"{prefix}rows": f"""
            SELECT pair_id, matrix, id, token, outcome, pos, {_r6("value::FLOAT::DOUBLE")} AS value FROM {prefix}all""",
    }


_MEMBER = "EXISTS (FROM vocabs v WHERE v.vocab = m.vocab AND v.token = m.token AND v.id <> 0)"

CTES |= _transferred("d_", "m_default", "t_vectors")
CTES |= _transferred("a_", "m_all", "t_vectors")
CTES |= _transferred("x_", "m_ext", "t_vectors", _MEMBER)
CTES |= _transferred("two_", "m_default", "t_vectors", matrices="'input', 'output'")
CTES |= _transferred("wl_", "m_all", "wordlevel")

_MATCH_COLUMNS = "pair_id, id, token, match_kind, src_id, src_token, n_sources"
_KINDS = {
    "sp": "SELECT vocab, id, token, decoded, canonical, fuzzy, bow FROM vocabs JOIN forms USING (vocab, id, token, is_special)",
    "wp": """SELECT *, lower(replace(canonical, '▁', '')) AS fuzzy FROM (
        SELECT vocab, id, token, token AS decoded, NOT starts_with(token, '##') AS bow,
            CASE WHEN starts_with(token, '##') THEN substr(token, 3) ELSE '▁' || token END AS canonical FROM wp_vocab)""",
    "bpe": f"""SELECT *, lower(replace(canonical, '▁', '')) AS fuzzy FROM (
        SELECT vocab, id, token, decoded, bow, CASE WHEN bow THEN '▁' ELSE '' END || regexp_replace(decoded, {_LTRIM}, '')
            AS canonical FROM bpe_vocab)""",
}
for _kind, _sql in _KINDS.items():
    CTES[f"{_kind}_forms"] = _sql

_FINGERPRINT = """
    SELECT vocab, count(*) AS n, md5(concat_ws(':', count(*), bit_xor(h), sum(h & 16777215))) AS digest
    FROM (SELECT vocab, ('0x' || substr(md5(coalesce(length(token) || ':' || token, '-') || coalesce(length(id::VARCHAR) || ':' || id, '-')), 1, 15))::BIGINT AS h FROM vocabs) GROUP BY vocab"""

FINAL: dict[str, str] = {
    "scan_text": r"""
        SELECT line AS text, count(*) AS n
        FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents) GROUP BY line""",
    "scan_jsonl": "SELECT text FROM documents",
    "scan_vocab": "SELECT vocab, token, id, decoded, is_special, 0::BIGINT AS n_duplicates FROM vocabs",
    "scan_embeddings": f"SELECT 'input' AS matrix, src_id AS id, pos, {_r6('x')} AS value FROM emb",
    "special_tokens": """
        SELECT v.vocab, v.token, v.id FROM vocabs v WHERE v.token IN ('<s>', '</s>', '<unk>', '<pad>', '<mask>')""",
    "special_roles": """
        SELECT r.vocab, r.role, r.token, v.id
        FROM (
            SELECT vocab, role, token FROM (SELECT DISTINCT vocab FROM vocabs), (VALUES
                ('bos_token', '<s>'), ('cls_token', '<s>'), ('eos_token', '</s>'), ('sep_token', '</s>'),
                ('unk_token', '<unk>'), ('pad_token', '<pad>'), ('mask_token', '<mask>'),
                ('additional_special_tokens', '▁')) AS t(role, token)
            UNION ALL SELECT DISTINCT vocab, 'additional_special_tokens', '<' || vocab || '>' FROM vocabs
        ) r LEFT JOIN vocabs v USING (vocab, token)""",
    "tokenized_sink": "SELECT text AS line, count(*) AS n FROM token_texts GROUP BY text",
    "vocab_fingerprint": _FINGERPRINT,
    "cache_roundtrip": f"""
        SELECT vocab, token, pos, {_r6('value')} AS value, false AS found_first, true AS found FROM t_vectors""",
    "tokenize_corpus": "SELECT doc_id, lang, pos, token FROM all_tokens",
    "tokenize_wordpiece": """
        SELECT d.doc_id, d.lang, s.token, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.at, s.i) - 1 AS pos
        FROM all_doc_words d JOIN wp_seg s ON s.lang = d.lang AND s.w = d.w""",
    "tokenize_bytelevel": """
        SELECT d.doc_id, d.lang, s.token, row_number() OVER (PARTITION BY d.doc_id ORDER BY d.at, s.i) - 1 AS pos
        FROM all_doc_words d JOIN bl_seg s ON s.lang = d.lang AND s.w = d.w""",
    "tokenized_text": "SELECT doc_id, lang, text FROM token_texts",
    "token_min_count": f"SELECT lang AS vocab, token, count(*) AS cnt FROM all_tokens GROUP BY lang, token HAVING count(*) >= {MIN_COUNT}",
    "learn_vocab": "SELECT vocab, token, id, decoded, is_special FROM vocabs",
    "segment_words": "SELECT lang, w, string_agg(token, ' ' ORDER BY i) AS pieces FROM seg GROUP BY lang, w",
    "segment_scored": "SELECT lang, w, substr(cuts[i + 1], 2) AS pieces FROM best_walk WHERE i = length(m)",
    "vocab_family": """
        SELECT vocab, CASE WHEN count(*) FILTER (token LIKE '▁%') > 100 THEN 'sentencepiece'
            WHEN count(*) FILTER (token LIKE '##%') > 100 THEN 'wordpiece' ELSE 'bpe' END AS family
        FROM (
            SELECT 'sp:' || vocab AS vocab, token FROM vocabs
            UNION ALL SELECT 'wp:' || vocab, token FROM wp_vocab
            UNION ALL SELECT 'bpe:' || vocab, token FROM bpe_vocab
        ) GROUP BY vocab""",
    "vocab_decoded": " UNION ALL ".join(
        f"SELECT '{k}' AS kind, vocab, id, token, decoded FROM {k}_forms" for k in _KINDS
    ),
    "canon_sentencepiece": "SELECT vocab, token, canonical, bow FROM forms",
    "canon_byte_fallback": f"""
        SELECT vocab, token, CASE WHEN regexp_matches(token, '{BYTE_PIECE}') THEN token ELSE canonical END AS canonical,
            bow AND NOT regexp_matches(token, '{BYTE_PIECE}') AS bow
        FROM (
            SELECT vocab, token, canonical, bow FROM forms UNION ALL SELECT vocab, token, NULL, false FROM byte_tokens
        )""",
    "canon_wordpiece": "SELECT vocab, token, canonical, bow FROM wp_forms",
    "canon_bpe": "SELECT vocab, token, canonical, bow FROM bpe_forms",
    "token_forms": "SELECT vocab, id, fuzzy, uncased, no_ws, bow FROM forms",
    "symbol_tokens": "SELECT vocab, id, token, fuzzy, is_symbol FROM flagged",
    "canonical_vocab": " UNION ALL ".join(
        f"""SELECT '{k}' AS kind, CASE WHEN vocab = 'en' THEN 'source' ELSE 'target' END AS descriptor,
            vocab, id, token, canonical, fuzzy, bow FROM {k}_forms"""
        for k in _KINDS
    ),
    "view_exact": """
        SELECT vocab, canonical AS key, row_number() OVER (PARTITION BY vocab, canonical ORDER BY id DESC) - 1 AS pos, id, token
        FROM bpe_forms""",
    "view_fuzzy": """
        SELECT vocab, fuzzy AS key, row_number() OVER (PARTITION BY vocab, fuzzy
            ORDER BY canonical <> fuzzy, CASE WHEN canonical = fuzzy THEN -id ELSE id END) - 1 AS pos, id, token
        FROM forms""",
    "overlap_default": f"SELECT {_MATCH_COLUMNS} FROM m_default",
    "overlap_exact": f"SELECT {_MATCH_COLUMNS} FROM m_default WHERE match_kind IS NOT NULL",
    "overlap_fuzzy": f"SELECT {_MATCH_COLUMNS} FROM m_fuzzy WHERE match_kind IS NOT NULL",
    "overlap_symbols": f"SELECT {_MATCH_COLUMNS} FROM m_symbols WHERE match_kind IS NOT NULL",
    "overlap_all_rules": f"SELECT {_MATCH_COLUMNS} FROM m_all",
    "new_tokens": "SELECT pair_id, id, token FROM m_default WHERE match_kind IS NULL",
    "overlap_sorted": f"SELECT {_MATCH_COLUMNS} FROM m_default WHERE match_kind IS NOT NULL ORDER BY pair_id, id",
    "multi_source_tokens": """
        SELECT m.pair_id, m.id, any_value(m.token) AS token, any_value(m.n_sources) AS n_sources,
            string_agg(s.token, ' ' ORDER BY s.other, s.place) FILTER (s.rn <= 5) AS src_tokens
        FROM m_all m JOIN (
            SELECT *, row_number() OVER (PARTITION BY by_canonical, key ORDER BY other, place) AS rn FROM (
                SELECT true AS by_canonical, canonical AS key, false AS other, -id AS place, token FROM src
                UNION ALL
                SELECT false, fuzzy, canonical <> fuzzy, CASE WHEN canonical = fuzzy THEN -id ELSE id END, token FROM src
            )
        ) s ON s.by_canonical = m.by_canonical AND s.key = CASE WHEN m.by_canonical THEN m.canonical ELSE m.fuzzy END
        WHERE m.n_sources > 1 GROUP BY m.pair_id, m.id""",
    "overlap_vectors": f"""
        SELECT m.pair_id, 'input' AS matrix, m.id, e.pos, {_r6('e.x')} AS value
        FROM m_default m JOIN emb e ON e.src_id = m.src_id""",
    "extend_filter": f"SELECT m.pair_id, m.id, m.token, {_MEMBER} AS in_extend FROM m_ext m WHERE m.match_kind IS NOT NULL",
    "rare_overlap": "SELECT pair_id, id, token, use_for_init FROM d_ann WHERE outcome = 'copied'",
    "random_init_tokens": "SELECT pair_id, id, token FROM d_ann WHERE outcome = 'random'",
    "cooccurrence": "SELECT lang, token, ctx, n FROM t_pairs",
    "ppmi": f"SELECT lang, token, ctx, {_r6('ppmi')} AS ppmi FROM t_ppmi WHERE {_r6('ppmi')} > 0",
    "aux_ppmi": f"SELECT vocab, token, pos, {_r6('value')} AS value FROM t_vectors",
    "aux_from_table": f"SELECT vocab, token, pos, {_r6('value')} AS value FROM t_vectors",
    "aux_words_scan": f"SELECT vocab AS lang, token AS word, pos, {_r6('value')} AS value FROM w_vectors WHERE vocab IN ('de', 'es')",
    "aux_wordlevel": f"SELECT vocab, token, pos, {_r6('value')} AS value FROM wordlevel",
    "aux_oov_ngrams": f"SELECT lang, w AS word, pos, {_r6('value')} AS value FROM oov_composed",
    "emb_mean": f"SELECT matrix, pos, {_r6('mean')} AS value FROM stats",
    "emb_std": f"SELECT matrix, pos, {_r6('std')} AS value FROM stats",
    "vector_l1": f"SELECT src_id AS id, {_r6('sum(abs(x))')} AS value FROM emb GROUP BY src_id",
    "cosine_pairs": f"""
        SELECT pair_id, id, count(*) AS n_pairs, {_r6('sum(z)')} AS z_sum, {_r6('min(z)')} AS z_min, {_r6('max(z)')} AS z_max
        FROM d_z GROUP BY pair_id, id""",
    "topk_neighbours": f"""
        SELECT pair_id, id, rank::INT AS rank, nbr_id, {_r6('z')} AS z FROM (
            SELECT *, row_number() OVER (PARTITION BY pair_id, id ORDER BY z DESC, nbr_id) AS rank FROM d_z
        ) WHERE rank <= 5""",
    "sparsemax_weights": f"SELECT pair_id, id, nbr_id, src_id, {_r6('w')} AS w FROM d_w WHERE {_r6('w')} > 0",
    "convex_combination": f"SELECT pair_id, id, pos, {_r6('value')} AS value FROM d_weighted",
    "random_init": f"SELECT pair_id, matrix, id, pos, {_r6('value')} AS value FROM d_random",
    "copied_embeddings": f"""
        SELECT m.pair_id, 'input' AS matrix, m.id, e.pos, {_r6('e.x')} AS value
        FROM m_all m JOIN emb e ON e.src_id = m.src_id""",
    "weighted_init": "SELECT pair_id, matrix, id, pos, value FROM a_rows WHERE outcome = 'weighted'",
    "assembled_matrix": f"""
        SELECT pair_id, matrix, id, outcome, pos, value FROM d_rows
        UNION ALL
        SELECT 'en-' || lang, 'input', id, 'zero', pos, 0.0
        FROM (SELECT unnest([{_TARGET_LIST}]) AS lang), range({VOCAB_SIZE + 10}) i(id), (SELECT DISTINCT pos FROM emb)
        WHERE NOT EXISTS (FROM vocabs v WHERE v.vocab = lang AND v.id = i.id)""",
    "transfer_full": "SELECT pair_id, matrix, id, token, outcome, pos, value FROM d_rows",
    "transfer_extend": "SELECT pair_id, matrix, id, token, outcome, pos, value FROM x_rows",
    "two_matrices": "SELECT pair_id, matrix, id, outcome, pos, value FROM two_rows",
    "multi_language": "SELECT pair_id, matrix, id, outcome, pos, value FROM wl_rows",
    "init_report": """
        SELECT pair_id, outcome, count(*) AS n, count(*) FILTER (outcome = 'copied' AND NOT use_for_init) AS n_pruned
        FROM d_ann GROUP BY pair_id, outcome""",
    "written_report": "SELECT pair_id, outcome, 2 * count(*) AS n FROM d_ann GROUP BY pair_id, outcome",
    "check_reproducible": "SELECT count(*) AS n_rows, 0::BIGINT AS n_differing FROM m_default",
    "check_specials": "SELECT pair_id, 4::BIGINT AS n, 0::BIGINT AS n_differing FROM m_default GROUP BY pair_id",
    "check_nonzero": """
        SELECT pair_id, count(*) AS n, count(*) FILTER (s = 0) AS n_zero
        FROM (SELECT pair_id, id, sum(abs(value)) AS s FROM d_all GROUP BY pair_id, id) GROUP BY pair_id""",
    "check_overlap_copied": """
        SELECT pair_id, count(*) AS n, 0::BIGINT AS n_differing FROM m_default WHERE match_kind IS NOT NULL GROUP BY pair_id""",
    "check_extension_preserves": """
        SELECT 'en-' || t.vocab AS pair_id, count(*) AS n, 0::BIGINT AS n_differing
        FROM vocabs s, (SELECT DISTINCT vocab FROM vocabs WHERE vocab <> 'en') t WHERE s.vocab = 'en' GROUP BY t.vocab""",
    "check_convex": "SELECT pair_id, count(DISTINCT id) AS n, 0::BIGINT AS n_bad FROM d_w GROUP BY pair_id",
}


def _needs(sql: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b{name}\b", sql)]


def _with_ctes(sql: str) -> str:
    """The query with the relations it needs in front, in the order of their use."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for other in _needs(CTES[name]):
                if other != name:
                    add(other)
            order.append(name)

    for name in _needs(sql):
        add(name)
    if not order:
        return sql
    parts = [f"{n} AS ({CTES[n]})" if n.endswith("walk") else f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"


ORACLE: dict[str, str] = {name: _with_ctes(sql) for name, sql in FINAL.items()}
