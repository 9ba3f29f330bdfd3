"""DuckDB SQL for the queries that SQL can express whole, by brute force and independent of the operators' ways."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: every window as a string, the first document of each, and the words that windows of later ones cover
REPEATS = f"""WITH w AS (SELECT doc_id, {WORDS} AS l FROM documents), win AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(l) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h), g AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN f USING (h), range(50) t(k) WHERE first < doc_id), r AS (SELECT doc_id, count(*) AS n, list(j) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS j FROM w) ANTI JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)"""

#: sets of shingles, documents that share one, and the components of those alike
JACCARD = f"""WITH w AS (SELECT doc_id, {WORDS} AS l FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g FROM (SELECT *, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [1] ELSE range(1, len(l) - 3) END) AS i FROM w)),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id), c AS (SELECT w.doc_id, coalesce(n, 0) AS n, coalesce(min(CASE WHEN h IS NOT NULL THEN w.doc_id END) OVER (PARTITION BY h), w.doc_id) AS copy_of FROM w LEFT JOIN z USING (doc_id)),
c2 AS (SELECT doc_id, n, CASE WHEN n = 0 THEN doc_id ELSE copy_of END AS copy_of FROM c), hs AS (SELECT s.doc_id, g, n FROM s JOIN c2 ON c2.doc_id = s.doc_id AND c2.copy_of = s.doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM hs a JOIN hs b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE k >= 0.8::DOUBLE * (na + nb - k) - 1e-9), m AS (SELECT a, min(b) AS c FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r) GROUP BY a), d AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, least(copy_of, coalesce(m.c, copy_of)) AS class_id, copy_of, coalesce(links, 0)::BIGINT AS n_links, n::BIGINT AS n_shingles FROM c2 LEFT JOIN m ON m.a = copy_of LEFT JOIN d ON d.a = copy_of"""

#: base32 of a SHA-1 by its bits
_HEX = "sha1(coalesce(html, ''))"
_BITS = "array_to_string(list_transform(range(1, 41), lambda i: list_extract(['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'], strpos('0123456789abcdef', substr(hex, i, 1)))), '')"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '')"
ARCHIVES = f"""WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, {_HEX} AS hex FROM pages), b AS (SELECT *, {_BITS} AS bits, max(page_id) OVER (PARTITION BY hex) AS last FROM h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS sound FROM b"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: all phrases of one to three words, counted, cut in every way, compared with longer ones
COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS l FROM p),
g AS (SELECT lang, l[i:i + k - 1] AS t FROM (SELECT lang, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w, range(1, 4) r(k) WHERE len(l) >= k)), f AS (SELECT lang, t, count(*) AS a FROM g GROUP BY ALL), n AS (SELECT lang, sum(len(l))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE len(t) > 1 AND a >= 10), u AS (SELECT c.lang, c.t, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score FROM c, range(1, 3) s(k) JOIN f x ON x.lang = c.lang AND x.t = c.t[1:k] JOIN f y ON y.lang = c.lang AND y.t = c.t[k + 1:] WHERE k < len(c.t)),
m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, k) = 1), gone AS (SELECT DISTINCT a.lang, a.t FROM c a JOIN c b ON a.lang = b.lang AND len(b.t) > len(a.t) AND (b.t[1:2] = a.t OR b.t[2:3] = a.t) AND 100 * b.a >= 50 * a.a),
k AS (SELECT m.lang, array_to_string(m.t, ' ') AS phrase, a, l, r, score FROM m ANTI JOIN gone USING (lang, t)) SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN n USING (lang) QUALIFY rank <= 2000"""

#: sets of shingles of lower-cased texts, documents that share one, and what is reachable over those alike
BOTTOMK = JACCARD.split(", p AS (", 1)[0].replace(WORDS, WORDS.replace("coalesce(text, '')", _LOWER)).replace("i + 4", "i + 2").replace("len(l) < 5", "len(l) < 3").replace("len(l) - 3", "len(l) - 1") + """, p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM hs a JOIN hs b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)), m AS (SELECT a, min(b) AS c FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r) GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, least(copy_of, coalesce(m.c, copy_of)) AS component_id, doc_id = least(copy_of, coalesce(m.c, copy_of)) AS kept FROM c2 LEFT JOIN m ON m.a = copy_of"""


def _assigned(n: int) -> str:
    return f"""d{n} AS (SELECT vec_id, c, list_sum(list_transform(list_zip(k.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM k, c{n} q), a{n} AS (SELECT vec_id, c, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)"""


def _moved(n: int) -> str:
    """Centroids after round ``n``."""
    return f"""s{n} AS (SELECT c, i, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{n} JOIN k USING (vec_id)) GROUP BY ALL), c{n + 1} AS (SELECT q.c, coalesce(s.v, q.v) AS v FROM c{n} q LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM s{n} GROUP BY c) s USING (c))"""


#: every vector against every centroid in every round
CENTROIDS = f"""WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < 16), {", ".join(f"{_assigned(n)}, {_moved(n)}" for n in range(3))}, {_assigned(3)}
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (c)"""

ORACLE = {"op2_repeated_phrases": REPEATS, "op5_ngram_jaccard_join": JACCARD, "op10_warc_archives": ARCHIVES, "op11_collocations": COLLOCATIONS, "op12_bottomk_near_duplicates": BOTTOMK, "op13_centroid_clustering": CENTROIDS}
