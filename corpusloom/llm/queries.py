"""The numbered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import collocations, decontaminate, html, language, mixing, neardup, packing, quality, sharding, spelling, substrings, topk, urls

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_simhash_decontamination": decontaminate.op2_simhash_decontamination,
    "op3_hierarchical_language_id": language.op3_hierarchical_language_id,
    "op4_probminhash_neardup": neardup.op4_probminhash_neardup,
    "op5_histogram_topk": topk.op5_histogram_topk,
    "op6_weak_label_quality": quality.op6_weak_label_quality,
    "op7_template_removal_html": html.op7_template_removal_html,
    "op8_feistel_shards": sharding.op8_feistel_shards,
    "op9_line_dedup": substrings.op9_line_dedup,
    "op10_template_tree_urls": urls.op10_template_tree_urls,
    "op11_automata_collocations": collocations.op11_automata_collocations,
    "op12_trie_spelling": spelling.op12_trie_spelling,
    "op13_hypergeometric_mixing": mixing.op13_hypergeometric_mixing,
}

WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"
BAG = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))"

ORACLES = {
    # Every window of a text beside every item with which it shares enough shingles, exactly.
    "op2_simhash_decontamination": f"""
WITH i AS (SELECT item_id, {BAG} AS b, len(w) - 4 AS size FROM (SELECT DISTINCT item_id, {WORDS.format("text")} AS w FROM benchmark) WHERE len(w) >= 5),
d AS (SELECT row_number() OVER () AS k, doc_id, {BAG} AS b, len(w) - 4 AS n FROM (SELECT doc_id, {WORDS.format("text")} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)) WHERE len(w) >= 5),
ip AS (SELECT item_id, size, s, count(*) AS times FROM (SELECT item_id, size, unnest(b) AS s FROM i) GROUP BY ALL),
dp AS (SELECT k, n, unnest(b) AS s, unnest(range(0, n)) AS pos FROM d),
hit AS (SELECT k, item_id, size, least(size, n) AS length, n, s, pos, times FROM dp JOIN ip USING (s) WHERE n >= 0.8 * size - 1e-9),
near AS (SELECT k, item_id FROM hit GROUP BY k, item_id, size, length HAVING count(*) >= ceil((size + length) * 4 / 9.0 - 1e-9)),
win AS (SELECT h.k, h.item_id, h.size, h.length, st.start, h.s, any_value(h.times) AS times, count(*) AS found FROM hit h JOIN near USING (k, item_id),
  LATERAL (SELECT unnest(range(greatest(0, h.pos - h.length + 1), least(h.pos, h.n - h.length) + 1)) AS start) st GROUP BY ALL),
sim AS (SELECT k, item_id, start, length, sum(least(found, times)) / (size + length - sum(least(found, times)))::DOUBLE AS similarity FROM win GROUP BY k, item_id, size, length, start),
best AS (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY similarity DESC, start) AS place FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, CAST(start AS INTEGER) AS first_word, CAST(length + 4 AS INTEGER) AS n_words FROM best JOIN d USING (k) WHERE place = 1
""",
    "op5_histogram_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 5
""",
    # All n-grams of one to three words, by place in their pieces.
    "op11_automata_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, g, a, unnest(range(1, k)) AS j FROM c),
scored AS (SELECT c.lang, c.g, c.a, c.j, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.g = c.g[: c.j] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.j + 1 :]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, unnest([g[:2], g[2:]]) AS g FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
    # The checksum goes over half bytes, the low one of each byte first; T has its fixed values. Near words share a word with one letter left out.
    "op12_trie_spelling": r"""
WITH t AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS t),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS start, run, count(*) AS n FROM r GROUP BY ALL),
x AS (SELECT run, n, hex(encode(start || run)) AS x FROM d),
c AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x)), lambda i: CAST(instr('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1 AS BIGINT)),
  lambda crc, b: xor(t[(xor(crc, b) & 15) + 1], crc >> 4), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM x, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE len(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
e AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS part FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
pair AS (SELECT DISTINCT a.word AS word, b.word AS other FROM e a JOIN e b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT a.word, b.word FROM e a JOIN v b ON a.part = b.word UNION SELECT b.word, a.word FROM e a JOIN v b ON a.part = b.word),
near AS (SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place FROM pair p JOIN v o ON o.word = p.other),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN near ON near.word = v.word AND place = 1),
up AS (WITH RECURSIVE up AS (SELECT word, form AS at FROM form WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN form f ON f.word = up.at WHERE f.form IS NOT NULL) SELECT * FROM up),
top AS (SELECT up.word, up.at AS root FROM up JOIN form f ON f.word = up.at WHERE f.form IS NULL)
SELECT form.word, form, coalesce(root, form.word) AS root, n, n_near, form_n FROM form LEFT JOIN top ON top.word = form.word
""",
}
