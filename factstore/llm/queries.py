"""The registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from factstore.llm import (automaton, decontaminate, dialogue, fingerprints, langid, lexical_ranking, sharding, simhash,
                           token_counts, token_files, toxicity, url_filters, warc)
from factstore.llm.common import table
from factstore.session import shared_folder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
TOKEN_LIMIT = 1024
SHARDS = 24
#: Host, path and verdict of each rule for pages.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _tokenizer():
    return token_counts.read_tokenizer(public_tokenizers.path(VOCABULARY))


def op1_bpe(spark, sf_dir) -> DataFrame:
    return automaton.digests(table(spark, sf_dir, "documents"),
                             automaton.read_vocabulary(public_tokenizers.path(VOCABULARY)))


def op2_simhash(spark, sf_dir) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer(),
                                     shared_folder(spark, "token-counts"), TOKEN_LIMIT)


def op5_language(spark, sf_dir) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), _tokenizer(), shared_folder(spark, "token-files"), END_ID)
    return token_files.read(manifest).drop("ids")


def op7_revisits(spark, sf_dir) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_lines(found["headers"]))


def op8_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_shards(spark, sf_dir) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), SHARDS, _tokenizer())


def op10_fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op11_url_filters(spark, sf_dir) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op12_dialogue_repair(spark, sf_dir) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_lexical_ranking(spark, sf_dir) -> DataFrame:
    return lexical_ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_decontaminate, op4_token_counts, op5_language, op6_token_files,
                                   op7_revisits, op8_toxicity, op9_shards, op10_fingerprints, op11_url_filters,
                                   op12_dialogue_repair, op13_lexical_ranking)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

_CRC = ("xor(list_reduce(list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)")
_CALLS = _CRC.format(x="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")


def _option(condition: str, cost: str, letters: str, behind: str, lines: str) -> str:
    """A way to go on from a state: its cost, audit and text, or one that is never the cheapest."""
    return (f"CASE WHEN {condition} THEN {{'c': {behind}.c + {cost}, 'a': '{letters}' || {behind}.a, 'b': {lines} || {behind}.b}} "
            "ELSE {'c': 1000000000, 'a': '', 'b': ''} END")


def _cheapest(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_LINE, _USER, _ASSISTANT = "chr(10) || role || ':' || text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"


def _edited(state: str, kept: list[tuple[str, str]], name: str, to: str) -> str:
    return _cheapest(_option("true", "3", "D", state, "''"),
                     *[_option(f"live AND initial = '{i}'", "late", "K", t, _LINE) for i, t in kept],
                     _option("live", "2 + late", "R", to, f"{name} || text"))


_EDITED = ", ".join(f"{edited} AS e{state}" for state, edited in (
    ("z", _edited("z", [("s", "s"), ("u", "u")], _USER, "u")), ("s", _edited("s", [("u", "u")], _USER, "u")),
    ("u", _edited("u", [("a", "a")], _ASSISTANT, "a")), ("a", _edited("a", [("u", "u")], _USER, "u"))))
_INSERTED = ", ".join(f"{_cheapest(*ways)} AS {state}" for state, ways in (
    ("z", ["ez", _option("true", "2", "I", "eu", _USER), _option("true", "4", "II", "ea", f"{_USER} || {_ASSISTANT}")]),
    ("s", ["es", _option("true", "2", "I", "eu", _USER), _option("true", "4", "II", "ea", f"{_USER} || {_ASSISTANT}")]),
    ("u", ["eu", _option("true", "2", "I", "ea", _ASSISTANT)]), ("a", ["ea", _option("true", "2", "I", "eu", _USER)])))

ORACLES = {
    "op3_decontaminate": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
               FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
               FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
               FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM hits) GROUP BY r)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op7_revisits": """
        WITH p AS (SELECT page_id, url, html, (page_id * 7919) % 1000003 AS turn, '"' || md5(html) || '"' AS tag FROM pages),
        c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p),
        k AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\\.|:(80|443)$', '', 'g') AS host,
                     regexp_extract(bare, '^[^/?]*(.*)$', 1) AS rest FROM c),
        u AS (SELECT *, host || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') ||
                     CASE WHEN regexp_extract(rest, '\\?(.*)$', 1) = '' THEN '' ELSE '?' ||
                     array_to_string(list_sort(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&')), '&') END AS canon FROM k),
        r AS (SELECT canon, turn AS ts, arg_max(struct_pack(id := 'r' || page_id, tag := tag, d := md5(html), n := strlen(html),
                     turn := turn), 'r' || page_id) AS res FROM u GROUP BY canon, turn),
        v AS (SELECT 'v' || page_id AS record_id, canon, turn + (page_id * 104729) % 2000003 - 600000 AS ts, page_id % 4 AS kind,
                     tag, turn - 500 AS stamp FROM u),
        j AS (SELECT v.*, r.res FROM v ASOF LEFT JOIN r ON v.canon = r.canon AND v.ts > r.ts),
        o AS (SELECT *, CASE WHEN res IS NULL THEN 'no_response'
                             WHEN kind IN (0, 1) AND tag = res.tag OR kind = 3 AND stamp = res.turn - 500 THEN 'resolved'
                             ELSE 'validator_mismatch' END AS outcome FROM j)
        SELECT record_id, canon AS url, ts, outcome, res.id AS response_id,
               CASE WHEN outcome = 'resolved' THEN res.d END AS digest,
               CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || res.n || chr(10) ||
                    'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || res.tag END AS headers
        FROM o""",
    "op11_url_filters": f"""
        WITH r AS (SELECT * FROM (VALUES {_RULES}) AS v(rule_host, rule_path, verdict)),
        u AS (SELECT page_id, row_number() OVER () AS k,
                     CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT k, arg_max({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) AS best
              FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (k)""",
    "op13_lexical_ranking": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        o AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
        g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS every FROM o),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q)
              GROUP BY r, term),
        f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
        s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // every))))::BIGINT AS score
              FROM q JOIN p USING (term) JOIN f USING (term) JOIN o USING (r), g GROUP BY item_id, r, doc_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50""",
    "op12_dialogue_repair": f"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
                               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
        m AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role,
                     coalesce(text, ' ') AS text, {_CALLS} % 20 AS h FROM conversations, t),
        g AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                     CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m),
        o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM g),
        f AS (SELECT *, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'b'
                             WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
                             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
                     lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM o),
        x AS (SELECT *, fault IN ('t', '-') AS live, (fault = 't')::INTEGER AS late FROM f),
        n AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                     count(*) FILTER (fault = 't') AS truncated,
                     count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY k),
        v AS (SELECT k, n + 1 AS i, {{'c': 0, 'a': '', 'b': ''}} AS z, {{'c': 4, 'a': 'II', 'b': {_USER} || {_ASSISTANT}}} AS s,
                     {{'c': 2, 'a': 'I', 'b': {_ASSISTANT}}} AS u, {{'c': 0, 'a': '', 'b': ''}} AS a FROM n
              UNION ALL
              SELECT k, i, {_INSERTED}
              FROM (SELECT v.k, x.i, {_EDITED} FROM v JOIN x ON v.k = x.k AND x.i = v.i - 1))
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost,
               coalesce(z.a, '') AS audit, sha256(substr(coalesce(z.b, ''), 2)) AS repaired_sha256
        FROM (SELECT DISTINCT k, conv_id FROM m) LEFT JOIN n USING (k) LEFT JOIN (SELECT * FROM v WHERE i = 1) USING (k)""",
}
