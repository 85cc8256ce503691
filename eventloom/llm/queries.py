"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import chat, collocations, exact_dedup, html_text, licenses, merkle, mixing, ngram_join, packing, pieces, pii, quality, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("source")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.preference_pairs(*chat.swapped_replies(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: spans(c) for c in ("chosen_train", "rejected_train")})


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", *[f"_f.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.TokenFiles(spark, path).checksums()


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.packed(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), end_id=1)
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "round", "deficit")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_preference_chat": op3_preference_chat,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_piece_encoding": op7_piece_encoding,
    "op8_html_text": op8_html_text,
    "op9_token_files": op9_token_files,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_mixture_packing": op12_mixture_packing,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _canonical(x: str) -> str:
    """licenses.canonical() in SQL."""
    x = f"trim(regexp_replace(regexp_replace(lower({x}), '{licenses.COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for other, same in licenses.SPELLINGS:
        x = f"replace({x}, '{other}', '{same}')"
    return f"sha256({x})"


def _em_rounds(rounds: int) -> str:
    """quality.learned() in SQL: what each round makes of the last one's masses and share, and the posterior in the end."""
    parts = []
    for k in range(rounds + 1):
        parts.append(f"given_{k} AS MATERIALIZED (SELECT r, v, y, mass / sum(mass) OVER (PARTITION BY r, y) AS p FROM em_{k})")
        parts.append(
            f"post_{k} AS MATERIALIZED (SELECT votes, any_value(n) AS n, 1 / (1 + exp(-(ln(g / (1 - g)) + sum(ln(p)) FILTER (y = 1) - sum(ln(p)) FILTER (y = 0)))) AS p "
            f"FROM pv JOIN given_{k} USING (r, v), good_{k} GROUP BY votes, g)"
        )
        if k < rounds:
            parts.append(f"good_{k + 1} AS MATERIALIZED (SELECT sum(n * p) / sum(n) AS g FROM post_{k})")
            parts.append(
                f"em_{k + 1} AS MATERIALIZED (SELECT r, v, y, any_value(mass) + coalesce(sum(CASE WHEN y = 1 THEN n * p ELSE n * (1 - p) END), 0) AS mass "
                f"FROM prior LEFT JOIN (SELECT r, v, post_{k}.n, p FROM pv JOIN post_{k} USING (votes)) USING (r, v) GROUP BY r, v, y)"
            )
    return ",\n        ".join(parts)


def _known(texts: list[tuple[str, str]]) -> str:
    quoted = [(name, text.replace("'", "''")) for name, text in texts]
    return "(VALUES " + ", ".join(f"('{name}', '{text}')" for name, text in quoted) + ") v(license, text)"


ORACLES: dict[str, str] = {
    "op1_source_mix": """
        WITH rows AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                   md5('mix:' || coalesce(doc_id::VARCHAR, '-')) AS digest
            FROM documents),
        sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM rows GROUP BY source),
        levels AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap,
                   row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k
            FROM sizes),
        steps AS (
            SELECT k, cap / weight AS own, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS of
            FROM levels),
        level AS (SELECT coalesce(min(k), 1000000000) AS k0, arg_min(rest, k) AS rest, arg_min(of, k) AS of FROM steps WHERE rest / of < own),
        targets AS (
            SELECT source, source_size, CASE WHEN k < k0 THEN cap ELSE weight * rest / of END AS target FROM levels, level),
        parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
        ordered AS (
            SELECT r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
                   sum(r.size) OVER (PARTITION BY r.source ORDER BY digest, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source),
        taken AS (
            SELECT *, whole + (part > 0 AND upto - size < part AND (upto <= part OR upto - part < part - (upto - size)))::BIGINT AS copies FROM ordered)
        SELECT doc_id, size::BIGINT AS size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM taken""",
    "op6_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        ranked AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept
            FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked""",
    "op3_preference_chat": """
        WITH own AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        last AS (SELECT pair_id, max(turn) AS last FROM own WHERE role = 'assistant' GROUP BY pair_id),
        reply AS (
            SELECT o.pair_id, max(o.text) AS reply FROM own o JOIN last l ON o.pair_id = l.pair_id AND o.turn = l.last
            WHERE role = 'assistant' GROUP BY o.pair_id),
        other AS (
            SELECT o.pair_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN reply ELSE text END AS text
            FROM own o LEFT JOIN last l ON o.pair_id = l.pair_id LEFT JOIN reply r ON r.pair_id = CASE WHEN o.pair_id % 2 = 0 THEN o.pair_id + 1 ELSE o.pair_id - 1 END
            WHERE NOT coalesce(role = 'assistant' AND turn = last, false) OR reply IS NOT NULL),
        counted AS (
            SELECT pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sum(c) AS c, sum(r) AS r
            FROM (SELECT *, 1 AS c, 0 AS r FROM own UNION ALL SELECT *, 0, 1 FROM other) GROUP BY ALL),
        parted AS (SELECT *, min(turn) FILTER (c <> r) OVER (PARTITION BY pair_id) AS parting FROM counted),
        parts AS (
            SELECT *, 'prompt' AS part, c AS n FROM parted WHERE coalesce(turn < parting, true)
            UNION ALL SELECT *, 'chosen', c FROM parted WHERE turn >= parting
            UNION ALL SELECT *, 'rejected', r FROM parted WHERE turn >= parting),
        copies AS (SELECT *, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM parts WHERE n > 0),
        segments AS (
            SELECT pair_id, part, turn, copy, role, turn // 256 * 256 AS piece, part <> 'prompt' AND role = 'assistant' AS train,
                   '<|im_start|>' || translate(replace(role, '<|im_', '<' || chr(8203) || '|im_'), chr(13) || chr(10), '  ') || chr(10) || replace(text, '<|im_', '<' || chr(8203) || '|im_') || '<|im_end|>' || chr(10) AS content
            FROM copies),
        placed AS (
            SELECT *, sum(length(content)) OVER (PARTITION BY pair_id, piece, part ORDER BY turn, role, content, copy) AS upto FROM segments)
        SELECT pair_id, piece, '' AS line, coalesce(string_agg(content, '' ORDER BY turn, role, content, copy) FILTER (part = 'prompt'), '') AS prompt,
               coalesce(string_agg(content, '' ORDER BY turn, role, content, copy) FILTER (part = 'chosen'), '') AS chosen,
               coalesce(string_agg((upto - length(content)) || ':' || upto, ',' ORDER BY upto) FILTER (part = 'chosen' AND train), '') AS chosen_train,
               coalesce(string_agg(content, '' ORDER BY turn, role, content, copy) FILTER (part = 'rejected'), '') AS rejected,
               coalesce(string_agg((upto - length(content)) || ':' || upto, ',' ORDER BY upto) FILTER (part = 'rejected' AND train), '') AS rejected_train
        FROM placed GROUP BY pair_id, piece""",
    "op4_license_scan": f"""
        WITH texts AS (SELECT license, {_canonical("text")} AS digest FROM {_known(list(licenses.TEXTS.items()))}),
        notices AS (SELECT license, {_canonical("text")} AS digest FROM {_known([(n, t) for n, some in licenses.NOTICES.items() for t in some])}),
        rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows),
        found AS (
            SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
            FROM (SELECT r, line FROM lines WHERE regexp_matches(lower(line), '{licenses.MARKERS}')) l JOIN notices ON {_canonical("l.line")} = digest GROUP BY r)
        SELECT doc_id, t.license AS text_license, coalesce(f.notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
        FROM rows LEFT JOIN found f USING (r) LEFT JOIN texts t ON {_canonical("rows.text")} = t.digest""",
    "op2_ngram_jaccard_join": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        reached AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, b FROM reached r JOIN links ON r.other = a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, min(other)) AS component_id
        FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n""",
    "op5_quality_rules": f"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1) GROUP BY doc_id),
        counts AS (
            SELECT doc_id, len(w) AS n_words, array_to_string(w, '') AS bare, length(array_to_string(w, '')) AS word_chars,
                   len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_lines,
                   len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_distinct,
                   coalesce(n_repeat_words, 0) AS n_repeat_words FROM docs LEFT JOIN covered USING (doc_id)),
        f AS (
            SELECT *, word_chars - length(regexp_replace(bare, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols, word_chars - length(regexp_replace(bare, '[!?]', '', 'g')) AS n_marks,
                   word_chars - length(regexp_replace(bare, '\\p{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(bare, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n_alnum FROM counts),
        voted AS (
            SELECT *, [CASE WHEN n_symbols < 0.03 * n_words THEN 1 WHEN n_symbols > 0.15 * n_words THEN -1 ELSE 0 END,
                       CASE WHEN n_alnum > 0.93 * word_chars THEN 1 WHEN n_alnum < 0.9 * word_chars THEN -1 ELSE 0 END, CASE WHEN n_words < 50 THEN -1 ELSE 0 END,
                       CASE WHEN n_upper > 0.3 * word_chars THEN -1 ELSE 0 END, CASE WHEN n_marks > 0.2 * n_words THEN -1 ELSE 0 END,
                       CASE WHEN n_words > 0 AND NOT word_chars / n_words BETWEEN 2.5 AND 12 THEN -1 ELSE 0 END, CASE WHEN n_lines - n_distinct > 0.3 * n_lines THEN -1 ELSE 0 END,
                       CASE WHEN n_repeat_words > 0.3 * n_words THEN -1 ELSE 0 END] AS votes FROM f),
        patterns AS (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
        pv AS MATERIALIZED (SELECT votes, n, unnest(range(1, 9)) AS r, votes[r] AS v FROM patterns),
        prior AS MATERIALIZED (
            SELECT r, v, y, (CASE WHEN v = 0 THEN {quality.PRIOR_ABSTAIN} WHEN (v = 1) = (y = 1) THEN {quality.PRIOR_RIGHT} ELSE {quality.PRIOR_WRONG} END)::DOUBLE AS mass
            FROM range(1, 9) a(r), range(-1, 2) b(v), range(0, 2) c(y)),
        em_0 AS MATERIALIZED (SELECT * FROM prior), good_0 AS MATERIALIZED (SELECT {quality.PRIOR_GOOD}::DOUBLE AS g),
        {_em_rounds(quality.ROUNDS)}
        SELECT doc_id, n_words, word_chars, n_symbols, n_lines - n_distinct AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p >= 0.5 AS kept
        FROM voted JOIN post_{quality.ROUNDS} USING (votes)""",
    "op11_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) t(k)),
        f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
        split AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        inside AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM split, range(2, 4) t(m) WHERE m < k)),
        covered AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY lang, phrase),
        cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w FROM split LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
        scored AS (
            SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT // (x.a + y.a)::HUGEINT)::BIGINT AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score, cut FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_merkle_manifest": """
        WITH RECURSIVE table_of AS (
            SELECT i AS byte, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
        crcs AS (SELECT list(v ORDER BY byte) AS t FROM table_of),
        rows AS (
            SELECT doc_id, lang, n_chars, '=' || lang AS grp,
                   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
                   xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
                                   lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 7 = 0 AS chosen
            FROM documents, crcs),
        leaves AS (
            SELECT doc_id, coalesce(grp, '') AS grp, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN chosen THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other FROM rows),
        placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
        nodes AS (
            SELECT grp, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM placed
            UNION ALL
            SELECT grp, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY grp, level, place // 2, n),
        subroots AS (SELECT grp, digest AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS rank FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, rank AS place, subroot AS digest, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, place // 2, n),
        met AS (
            SELECT p.grp, p.place, d.level, (p.place >> d.level) % 2 = 1 AS on_left, d.digest AS sibling
            FROM placed p JOIN nodes d ON d.grp = p.grp AND d.n > 1 AND d.place = xor(p.place >> d.level, 1)
            UNION ALL
            SELECT p.grp, p.place, s.height + d.level, (s.rank >> d.level) % 2 = 1, d.digest
            FROM placed p JOIN subroots s USING (grp) JOIN tops d ON d.n > 1 AND d.place = xor(s.rank >> d.level, 1)),
        proofs AS (SELECT grp, place, sha256(string_agg(sibling, '' ORDER BY level)) AS proof, count(*) AS n_siblings FROM met GROUP BY grp, place),
        paths AS (SELECT grp, height + (SELECT max(level) FROM tops) AS levels FROM subroots),
        folded AS (
            SELECT grp, place, 0 AS level, coalesce(other, leaf) AS digest FROM placed
            UNION ALL
            SELECT f.grp, f.place, f.level + 1, sha256(CASE WHEN m.on_left THEN m.sibling || f.digest ELSE f.digest || coalesce(m.sibling, '') END)
            FROM folded f JOIN paths h ON h.grp = f.grp AND f.level < h.levels LEFT JOIN met m ON m.grp = f.grp AND m.place = f.place AND m.level = f.level)
        SELECT doc_id, leaf, subroot, t.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified, coalesce(n_siblings, 0)::BIGINT AS n_siblings
        FROM placed p JOIN subroots USING (grp) JOIN paths h USING (grp) JOIN folded f ON f.grp = p.grp AND f.place = p.place AND f.level = h.levels
             LEFT JOIN proofs x ON x.grp = p.grp AND x.place = p.place, (SELECT digest FROM tops WHERE n = 1) t""",
}
