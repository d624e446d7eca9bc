"""DuckDB SQL for the queries of `registry`, put together from shared common table expressions."""

from __future__ import annotations

from glosswork.functions.alphabet import LETTERS, REJECT
from glosswork.operators.morphology import RULES

W = r"[\p{L}\p{N}_]"
ABC = LETTERS.replace("'", "''")
NONE = "none of the above"

CTE = {
    "lex": rf"""lexw AS (SELECT item_id, text AS definition, substr('nvasr', (item_id % 5 + 1)::int, 1) AS pos,
      unnest(list_distinct(list_transform(regexp_extract_all(text, '{W}+'), lambda w: lower(w)))) AS form FROM benchmark),
    lex AS (SELECT form, pos, row_number() OVER (PARTITION BY form, pos ORDER BY item_id) - 1 AS ord,
      'syn-' || lpad(item_id::varchar, 8, '0') || '-' || pos AS synset_id, definition, item_id FROM lexw WHERE regexp_matches(form, '^[a-z]{{4,}}$'))""",
    "asked": "asked AS (SELECT form, pos, form || '/' || pos AS query_id FROM (SELECT DISTINCT form FROM lex) CROSS JOIN (VALUES ('n'), ('v'), ('a'), ('r')) p(pos))",
    "ask": "ask(pos, ask, turn) AS (VALUES ('n', 'n', 0), ('v', 'v', 0), ('a', 'a', 0), ('a', 's', 1), ('r', 'r', 0), ('s', 's', 0))",
    "defs": """defs AS (SELECT query_id, q.form, q.pos, row_number() OVER (PARTITION BY query_id ORDER BY turn, l.ord) - 1 AS ord, synset_id, definition
      FROM asked q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask)""",
    "major": """major AS (SELECT form, pos, senses FROM (SELECT form, pos, count(*) AS senses, min(synset_id) AS first,
      row_number() OVER (PARTITION BY form ORDER BY count(*) DESC, min(synset_id)) AS r FROM lex GROUP BY form, pos) WHERE r = 1)""",
    "tok": rf"""seg AS (SELECT doc_id, regexp_extract_all(text, '{W}+|[^\p{{L}}\p{{N}}_]') AS s FROM documents),
    cut AS (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM seg),
    run AS (SELECT doc_id, word, NOT regexp_matches(word, '^[ \t\n\r\f\x0B]$') AS solid, sum(length(word)) OVER w AS end_char,
      sum((NOT regexp_matches(word, '^[ \t\n\r\f\x0B]$'))::int) OVER w - 1 AS position FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    tok AS (SELECT doc_id, position::bigint AS position, word, (end_char - length(word))::bigint AS start_char, end_char::bigint AS end_char, lower(word) AS lemma FROM run WHERE solid)""",
    "tagged": rf"""tagged AS (SELECT t.*, CASE WHEN NOT regexp_matches(word, '^{W}') THEN 'PUNCT' WHEN m.pos = 'n' THEN 'NOUN' WHEN m.pos = 'v' THEN 'VERB'
      WHEN m.pos IN ('a', 's') THEN 'ADJ' WHEN m.pos = 'r' THEN 'ADV' ELSE 'X' END AS pos FROM tok t LEFT JOIN major m ON m.form = t.lemma),
    content AS (SELECT *, CASE pos WHEN 'NOUN' THEN 'n' WHEN 'VERB' THEN 'v' WHEN 'ADJ' THEN 'a' WHEN 'ADV' THEN 'r' END AS lex_pos FROM tagged WHERE pos NOT IN ('PUNCT', 'X'))""",
    "pred": f"""context AS (SELECT DISTINCT doc_id, lemma FROM tagged WHERE regexp_matches(word, '^[A-Za-z]{{4,}}$')),
    shared AS (SELECT doc_id, synset_id, count(*) AS n FROM context JOIN lex ON form = lemma GROUP BY ALL),
    once AS (SELECT DISTINCT doc_id, lemma AS form, lex_pos AS pos FROM content),
    sense AS (SELECT doc_id, q.form, q.pos, row_number() OVER (PARTITION BY doc_id, q.form, q.pos ORDER BY turn, l.ord) - 1 AS ord, synset_id, definition
      FROM once q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask),
    cand AS (SELECT s.*, coalesce(n - 1, 0) AS logit FROM sense s LEFT JOIN shared USING (doc_id, synset_id)
      UNION ALL SELECT DISTINCT doc_id, form, pos, {REJECT}, '', '{NONE}', 0 FROM sense),
    pred AS (SELECT doc_id, form, pos, synset_id, definition, round(p, 6) AS confidence, ord = {REJECT} AS rejected FROM (SELECT *,
      exp(logit - max(logit) OVER q) / sum(exp(logit - m)) OVER q AS p, row_number() OVER (PARTITION BY doc_id, form, pos ORDER BY logit DESC, ord) AS r
      FROM (SELECT *, max(logit) OVER (PARTITION BY doc_id, form, pos) AS m FROM cand) WINDOW q AS (PARTITION BY doc_id, form, pos)) WHERE r = 1)""",
    "resolved": """resolved AS (SELECT t.doc_id, position, word, lemma, t.pos, start_char, end_char, CASE WHEN NOT rejected THEN synset_id END AS synset_id,
      CASE WHEN NOT rejected THEN definition END AS synset_definition, confidence FROM tagged t LEFT JOIN pred p ON p.doc_id = t.doc_id AND p.form = t.lemma
      AND p.pos = CASE t.pos WHEN 'NOUN' THEN 'n' WHEN 'VERB' THEN 'v' WHEN 'ADJ' THEN 'a' WHEN 'ADV' THEN 'r' END)""",
    "scored": f"""scored AS (SELECT query_id, ord, synset_id, definition, length(definition) % 7 AS logit FROM defs
      UNION ALL SELECT DISTINCT query_id, {REJECT}, '', '{NONE}', 3 FROM defs)""",
    "shares": """shares AS (SELECT *, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, ord) AS r
      FROM (SELECT *, max(logit) OVER (PARTITION BY query_id) AS m FROM scored))""",
    "marks": rf"""marks AS (SELECT synset_id, form, pos, definition, CASE WHEN position('*' IN definition) = 0 AND m <> definition THEN m END AS marked FROM
      (SELECT *, regexp_replace(definition, '(^|[^\p{{L}}\p{{N}}_])(' || form || ')($|[^\p{{L}}\p{{N}}_])', '\1*\2*\3', 'i') AS m FROM lex))""",
    "examples": """examples AS (SELECT synset_id, form, pos, definition AS sentence, marked FROM marks JOIN
      (SELECT form, pos FROM lex GROUP BY ALL HAVING count(*) > 1) USING (form, pos) WHERE marked IS NOT NULL)""",
    "split": """per AS (SELECT synset_id, count(*) AS n FROM examples GROUP BY ALL),
    parts AS (SELECT synset_id, CASE WHEN coalesce(sum(n) OVER (ORDER BY md5('42:' || synset_id), synset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 THEN 'eval' ELSE 'bench' END AS part FROM per)""",
    "judged": """askede AS (SELECT DISTINCT form, pos FROM examples),
    best AS (SELECT form, pos, arg_min(synset_id, row(-length(definition), turn, ord)) AS predicted FROM
      (SELECT q.form, q.pos, synset_id, definition, turn, l.ord FROM askede q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask) GROUP BY ALL),
    judged AS (SELECT e.*, predicted, predicted = synset_id AS correct, synset_id || '/' || form AS key FROM examples e JOIN best USING (form, pos)),
    numbered AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS idx FROM judged)""",
    "local": """local AS (SELECT query_id, form, pos, row_number() OVER (PARTITION BY query_id ORDER BY place, synset_id) - 1 AS ord, synset_id, definition FROM
      (SELECT query_id, q.form, q.pos, synset_id, min(row(turn, l.ord)) AS place, arg_max(definition, row(turn, l.ord)) AS definition FROM asked q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask WHERE definition <> '' GROUP BY ALL))""",
    "gaz": rf"""two AS (SELECT item_id, regexp_extract_all(text, '{W}+') AS w FROM benchmark),
    gaz AS (SELECT lower(label) AS label, min(id) AS id FROM (SELECT concat_ws(' ', w[1], w[2]) AS label, item_id AS id FROM two UNION ALL SELECT w[1], item_id + 1000000 FROM two)
      WHERE label IS NOT NULL AND label <> '' GROUP BY lower(label))""",
    "spans": """spans AS (SELECT t.doc_id, g.id, t.position AS start_token, t.position + len(string_split(label, ' ')) - 1 AS end_token, label AS text
      FROM (SELECT *, lead(lemma) OVER (PARTITION BY doc_id ORDER BY position) AS nxt FROM tok) t JOIN gaz g
      ON string_split(label, ' ')[1] = lemma AND (len(string_split(label, ' ')) = 1 OR string_split(label, ' ')[2] = nxt))""",
    "lemmas": rf"""rule(r, p, suffix, ending) AS (VALUES {", ".join(f"({i}, '{p}', '{x}', '{y}')" for i, (p, x, y) in enumerate(RULES))}),
    vocab AS (SELECT DISTINCT lower(word) AS word FROM tok WHERE regexp_matches(word, '^{W}')),
    known AS (SELECT form AS lemma, CASE WHEN pos = 's' THEN 'a' ELSE pos END AS p, count(*) AS senses FROM lex GROUP BY ALL),
    exc AS (SELECT reverse(form) AS word, min(CASE WHEN pos = 's' THEN 'a' ELSE pos END) AS p, form AS lemma FROM lex GROUP BY form),
    made AS (SELECT word, 2 AS kind, length(suffix) AS cut, p, left(word, length(word) - length(suffix)) || ending AS lemma FROM vocab JOIN rule ON ends_with(word, suffix) AND length(word) > length(suffix)
      UNION ALL SELECT word, 1, 0, p, lemma FROM vocab JOIN exc USING (word)),
    every AS (SELECT word, kind, cut, p, lemma, senses FROM made JOIN known USING (lemma, p) UNION ALL
      SELECT word, 0, 0, CASE WHEN pos = 's' THEN 'a' ELSE pos END, word, senses FROM vocab JOIN major ON form = word),
    lemmas AS (SELECT word, lemma, p AS pos FROM every QUALIFY row_number() OVER (PARTITION BY word ORDER BY kind, cut DESC, senses DESC, position(p IN 'nvar'), lemma, p) = 1)""",
    "tagged_by_lemmas": rf"""tagged AS (SELECT t.doc_id, position, t.word, start_char, end_char, coalesce(m.lemma, t.lemma) AS lemma, CASE WHEN NOT regexp_matches(t.word, '^{W}') THEN 'PUNCT' WHEN m.pos = 'n' THEN 'NOUN'
      WHEN m.pos = 'v' THEN 'VERB' WHEN m.pos = 'a' THEN 'ADJ' WHEN m.pos = 'r' THEN 'ADV' ELSE 'X' END AS pos FROM tok t LEFT JOIN lemmas m ON m.word = t.lemma),
    content AS (SELECT *, CASE pos WHEN 'NOUN' THEN 'n' WHEN 'VERB' THEN 'v' WHEN 'ADJ' THEN 'a' WHEN 'ADV' THEN 'r' END AS lex_pos FROM tagged WHERE pos NOT IN ('PUNCT', 'X'))""",
    "nest": rf"""syn AS (SELECT item_id AS nr, 'syn-' || lpad(item_id::varchar, 8, '0') || '-' || substr('nvasr', (item_id % 5 + 1)::int, 1) AS synset_id, substr('nvasr', (item_id % 5 + 1)::int, 1) AS pos, text AS definition,
      list_filter(list_distinct(list_transform(regexp_extract_all(text, '{W}+'), lambda w: lower(w))), lambda w: regexp_matches(w, '^[a-z]{{4,}}$')) AS bag, regexp_extract_all(text, '{W}+') AS run,
      CASE WHEN item_id % 4 = 3 THEN []::varchar[] ELSE list_concat(list_filter(string_split(text, '.'), lambda x: x <> ''), [text]) END AS examples FROM benchmark),
    wordn AS (SELECT *, list_position(list_transform(run, lambda w: lower(w)), lemma) AS spot FROM (SELECT nr, synset_id, pos, definition, examples, run, unnest(bag) AS lemma FROM syn)),
    entries AS (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY spot) - 1 AS word_nr FROM wordn),
    formn AS (SELECT e.*, f.form_nr, CASE f.form_nr WHEN 0 THEN lemma ELSE lemma || 's' END AS form FROM entries e CROSS JOIN (VALUES (0), (1)) f(form_nr)),
    examplen AS (SELECT *, unnest(examples) AS sentence, generate_subscripts(examples, 1) - 1 AS example_nr FROM formn),
    exmark AS (SELECT *, CASE WHEN contains(lower(sentence), form) THEN regexp_replace(sentence, '(^|[^\p{{L}}\p{{N}}_])(' || form || ')($|[^\p{{L}}\p{{N}}_])', '\1*\2*\3', 'i') END AS marked FROM examplen),
    usable AS (SELECT nr, word_nr, form_nr, example_nr, synset_id, form, lemma, pos, sentence, marked FROM exmark JOIN (SELECT lemma, pos FROM entries GROUP BY ALL HAVING count(DISTINCT synset_id) > 1) USING (lemma, pos)
      WHERE position('*' IN sentence) = 0 AND marked <> sentence)""",
    "labels": rf"""piece AS (SELECT item_id, text, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS p FROM benchmark),
    label AS (SELECT label, min(item_id) AS id FROM (SELECT item_id, unnest(list_concat([text, array_to_string(p[1:3], ' ')], list_filter(p, lambda x: regexp_matches(x, '[^\p{{L}}\p{{N}}_]')))) AS label FROM piece) GROUP BY label),
    entry AS (SELECT id, label, list_transform(list_filter(regexp_extract_all(label, '{W}+|[^\p{{L}}\p{{N}}_]'), lambda x: NOT regexp_matches(x, '^[ \t\n\r\f\x0B]$')), lambda x: lower(x)) AS w FROM label),
    tokm AS MATERIALIZED (SELECT doc_id, position, lemma FROM tok),
    cand AS (SELECT a.doc_id, a.position AS start_token, e.* FROM tokm a JOIN entry e ON a.lemma = e.w[1] JOIN tokm b ON b.doc_id = a.doc_id AND b.position = a.position + len(e.w) - 1 AND b.lemma = e.w[len(e.w)]),
    word AS (SELECT doc_id, start_token, id, label, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM cand),
    lspan AS MATERIALIZED (SELECT v.doc_id, id, start_token, start_token + any_value(n) - 1 AS end_token, label AS text FROM word v JOIN tokm t ON t.doc_id = v.doc_id AND t.position = v.start_token + i AND t.lemma = x GROUP BY v.doc_id, id, start_token, label HAVING count(*) = any_value(n))""",
    # labels have one or two words, so overlapping spans are chains of neighbours, of which every other one stays
    "greedy": """best AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id, start_token ORDER BY end_token DESC, id) = 1),
    chain AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_token) AS chain FROM
      (SELECT *, (coalesce(lag(end_token) OVER (PARTITION BY doc_id ORDER BY start_token), -1) < start_token)::int AS fresh FROM best)),
    greedy AS (SELECT doc_id, id, start_token, end_token, text FROM chain QUALIFY row_number() OVER (PARTITION BY doc_id, chain ORDER BY start_token) % 2 = 1)""",
    "words": """words AS (SELECT form AS word, synset_id AS id, pos, definition AS source_definition, array_to_string(list_reverse(string_split(definition, ' ')), ' ') AS alternative_definition,
      [definition, array_to_string(string_split(definition, ' ')[1:len(string_split(definition, ' ')) // 2], ' '), array_to_string(string_split(definition, ' ')[len(string_split(definition, ' ')) // 2 + 1:], ' ')] AS examples,
      row_number() OVER (PARTITION BY form ORDER BY synset_id) - 1 AS ord FROM lex)""",
    "sent": rf"""sent0 AS (SELECT word, pos, id, unnest(examples) AS sentence, generate_subscripts(examples, 1) - 1 AS nr FROM words),
    sent AS (SELECT *, m AS marked FROM (SELECT *, regexp_replace(sentence, '(^|[^\p{{L}}\p{{N}}_])(' || word || ')($|[^\p{{L}}\p{{N}}_])', '\1*\2*\3', 'i') AS m FROM sent0)
      WHERE position('*' IN sentence) = 0 AND m <> sentence)""",
    "train": f"""opts AS (SELECT a.word, a.pos, a.id, b.id AS option_id, CASE WHEN ('0x' || substr(md5('42:pick:' || a.word || ':' || a.id || ':' || b.id), 1, 8))::bigint % 2 = 0 THEN b.source_definition ELSE b.alternative_definition END AS definition,
      row_number() OVER (PARTITION BY a.word, a.pos, a.id ORDER BY md5('42:order:' || a.word || ':' || a.id || ':' || b.id), b.id) - 1 AS o FROM words a JOIN words b ON a.word = b.word AND a.pos = b.pos),
    optn AS (SELECT word, pos, id, count(*) AS n, max(CASE WHEN id = option_id THEN o END) AS place FROM opts GROUP BY ALL HAVING count(*) <= {REJECT}),
    sento AS (SELECT s.*, n, place, ('0x' || substr(md5('42:offset:' || word || ':' || id || ':' || nr), 1, 8))::bigint % ({REJECT} - n + 1) AS off FROM sent s JOIN optn USING (word, pos, id)),
    lines AS (SELECT s.word, s.id, s.nr, s.sentence, s.marked, s.place, s.off, string_agg(substr('{ABC}', (o + off + 1)::int, 1) || '. ' || definition, chr(10) ORDER BY o) AS txt FROM sento s JOIN opts USING (word, pos, id) GROUP BY ALL),
    train AS (SELECT word, id AS synset_id, nr, substr('{ABC}', (place + off + 1)::int, 1) AS answer,
      'What is the meaning of *' || word || '* in this sentence?' || chr(10) || chr(10) || 'Sentence: ' || marked || chr(10) || chr(10) || txt || chr(10) || '{LETTERS[REJECT]}. {NONE}' || chr(10) || chr(10) || 'Answer: [unused0] [MASK]' AS prompt FROM lines)""",
    "tmajor": "tmajor AS (SELECT word, pos, n FROM (SELECT word, pos, count(*) AS n, row_number() OVER (PARTITION BY word ORDER BY count(*) DESC, min(ord)) AS r FROM words GROUP BY word, pos) WHERE r = 1)",
    "reject": f"""rsent AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY word ORDER BY md5('42:reject:' || word || ':' || id || ':' || nr), id, nr) AS r FROM sent s JOIN tmajor m USING (word) WHERE s.pos <> m.pos) WHERE r = 1),
    ropt AS (SELECT word, CASE WHEN ('0x' || substr(md5('42:rejectpick:' || word || ':' || id), 1, 8))::bigint % 2 = 0 THEN source_definition ELSE alternative_definition END AS definition,
      row_number() OVER (PARTITION BY word ORDER BY md5('42:rejectorder:' || word || ':' || id), id) - 1 AS o, count(*) OVER (PARTITION BY word) AS n FROM words w JOIN tmajor m USING (word) WHERE w.pos = m.pos),
    rline AS (SELECT s.word, s.id, s.nr, s.marked, string_agg(substr('{ABC}', (o + ('0x' || substr(md5('42:rejectoffset:' || s.word), 1, 8))::bigint % ({REJECT} - n + 1) + 1)::int, 1) || '. ' || definition, chr(10) ORDER BY o) AS txt
      FROM rsent s JOIN ropt USING (word) WHERE n <= {REJECT} GROUP BY ALL),
    rej AS (SELECT word, id || '_none' AS synset_id, nr, '{LETTERS[REJECT]}' AS answer, 'What is the meaning of *' || word || '* in this sentence?' || chr(10) || chr(10) || 'Sentence: ' || marked || chr(10) || chr(10) || txt || chr(10) || '{LETTERS[REJECT]}. {NONE}' || chr(10) || chr(10) || 'Answer: [unused0] [MASK]' AS prompt FROM rline)""",
    "enc": f"""codes AS (SELECT item_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda c: ('0x' || c)::int + 2) AS c FROM benchmark),
    ids AS (SELECT item_id, list_concat(list_concat(c[1:len(c) // 2], [1]), c[len(c) // 2 + 1:]) AS ids, substr('{ABC}', (item_id % 127 + 1)::int, 1) AS answer FROM codes),
    enc AS (SELECT item_id, answer, ids[1:2048] AS input_ids, list_position(ids[1:2048], 1)::bigint AS place, item_id % 127 AS label FROM ids)""",
    "conv": "conv AS (SELECT conv_id || '/' || turn AS key, length(text) AS len, row_number() OVER (ORDER BY length(text), conv_id || '/' || turn) - 1 AS idx FROM conversations)",
}


def sql(needs: str, select: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in needs.split()) + "\n" + select


RESOLVE = "lex ask major tok tagged pred"
SQL = {
    "disambiguate_documents": sql(RESOLVE + " resolved", "SELECT doc_id, position, word, lemma, pos, start_char, end_char, synset_id, confidence FROM resolved"),
    "predictions": sql(RESOLVE, "SELECT doc_id, form, pos, synset_id, definition, confidence, rejected FROM pred"),
    "lookup_definitions": sql("lex asked", "SELECT query_id, q.form, q.pos, ord, synset_id, definition FROM asked q LEFT JOIN lex l ON l.form = q.form AND l.pos = q.pos"),
    "lookup_adj_expansion": sql("lex asked ask defs", "SELECT * FROM defs"),
    "local_definition_map": sql("lex asked ask local", "SELECT * FROM local"),
    "lexicon_forms": sql("lex", "SELECT DISTINCT form FROM lex"),
    "sense_counts": sql("lex", "SELECT form, pos, count(*) AS senses FROM lex GROUP BY ALL"),
    "polysemous_forms": sql("lex", "SELECT form, pos, count(*) AS senses FROM lex GROUP BY ALL HAVING count(*) > 1"),
    "majority_pos": sql("lex major", "SELECT * FROM major"),
    "base_tokens": sql("tok", "SELECT doc_id, position, word, start_char, end_char FROM tok"),
    "content_words": sql("lex major tok tagged", "SELECT doc_id, position, lemma, pos, lex_pos FROM content"),
    "word_queries": sql("lex major tok tagged", "SELECT lemma AS form, lex_pos AS pos, count(*) AS asked FROM content GROUP BY ALL"),
    "mark_by_index": sql("lex major tok tagged", "SELECT c.doc_id, position, md5(substr(text, 1, start_char) || '*' || word || '*' || substr(text, end_char + 1)) AS marked_md5 FROM content c JOIN documents d USING (doc_id)"),
    "mark_by_search": sql("lex marks", "SELECT synset_id, form, marked FROM marks"),
    "option_letters": sql("lex asked ask defs", f"SELECT query_id, ord, substr('{ABC}', (ord + 1)::int, 1) AS letter, synset_id, definition FROM defs UNION ALL SELECT DISTINCT query_id, {REJECT}, '{LETTERS[REJECT]}', '', '{NONE}' FROM defs"),
    "render_prompt": sql("lex asked ask defs", f"""SELECT query_id, 'What is the meaning of *' || form || '* in this sentence?' || chr(10) || chr(10) || 'Sentence: Say *' || form || '*.' || chr(10) || chr(10)
      || string_agg(substr('{ABC}', (ord + 1)::int, 1) || '. ' || definition, chr(10) ORDER BY ord) || chr(10) || '{LETTERS[REJECT]}. {NONE}' || chr(10) || chr(10) || 'Answer: [unused0] [MASK]' AS prompt FROM defs GROUP BY query_id, form"""),
    "answer_alphabet": sql("lex asked ask defs", f"""SELECT i AS idx, substr('{ABC}', (i + 1)::int, 1) AS letter, coalesce(n, 0) AS options FROM range(128) t(i) LEFT JOIN
      (SELECT ord, count(*) AS n FROM (SELECT ord FROM defs UNION ALL SELECT {REJECT} FROM (SELECT DISTINCT query_id FROM defs)) GROUP BY ord) ON ord = i"""),
    "entity_spans": sql("tok gaz spans", "SELECT * FROM spans"),
    "ndjson_stream": "SELECT conv_id AS stream_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS content_md5 FROM conversations WHERE turn <= 2 GROUP BY conv_id HAVING max(turn) = 2",
    "generation_run": sql("lex", """, f AS (SELECT form, count(*) AS n, max(md5('~' || definition)) AS m FROM lex GROUP BY form), a AS (SELECT form FROM f UNION SELECT 'un' || form FROM f)
    SELECT form, CASE WHEN n IS NULL THEN 'no synset' WHEN n = 1 THEN 'one synset' WHEN length(form) = 9 THEN 'failed' ELSE 'made' END AS outcome, CASE WHEN n > 1 AND length(form) = 9 THEN 'no answer' END AS message,
      CASE WHEN n > 1 AND length(form) <> 9 THEN n END AS senses, CASE WHEN n > 1 AND length(form) <> 9 THEN m END AS greatest_md5 FROM a LEFT JOIN f USING (form)"""),
    "occurrence_choices": sql("lex ask major tok tagged", f""", pairs AS (SELECT DISTINCT lemma AS form, lex_pos AS pos FROM content),
    sense AS (SELECT q.form, q.pos, row_number() OVER (PARTITION BY q.form, q.pos ORDER BY turn, l.ord) - 1 AS ord, synset_id, definition FROM pairs q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask),
    pack AS (SELECT form, pos, count(*) AS n, list(synset_id ORDER BY ord) AS ids, string_agg(substr('{ABC}', (ord + 1)::int, 1) || '. ' || definition, chr(10) ORDER BY ord) AS txt FROM sense GROUP BY ALL HAVING count(*) <= {REJECT}),
    asked AS (SELECT c.doc_id, position, lemma, n, ids, ('0x' || substr(md5('What is the meaning of *' || word || '* in this sentence?' || chr(10) || chr(10) || 'Sentence: ' || substr(text, 1, start_char) || '*' || word || '*' || substr(text, end_char + 1) || chr(10) || chr(10) || txt || chr(10)
      || '{LETTERS[REJECT]}. {NONE}' || chr(10) || chr(10) || 'Answer: [unused0] [MASK]'), 1, 8))::bigint AS h FROM content c JOIN pack ON form = lemma AND pack.pos = lex_pos JOIN documents d ON d.doc_id = c.doc_id),
    z AS (SELECT *, list_transform(list_concat(range(0, n), [{REJECT}]), lambda i: (h + i * 7919) % 1000 / 100) AS z FROM asked)
    SELECT doc_id, position, lemma, CASE WHEN list_position(z, list_max(z)) <= n THEN ids[list_position(z, list_max(z))] END AS synset_id, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS confidence FROM z"""),
    "lemmas": sql("lex major tok lemmas", "SELECT * FROM lemmas"),
    "lemmatised_tokens": sql("lex major tok lemmas tagged_by_lemmas", "SELECT doc_id, position, word, lemma, pos FROM tagged"),
    "disambiguate_lemmatised": sql("lex ask major tok lemmas tagged_by_lemmas pred resolved", "SELECT doc_id, position, word, lemma, pos, start_char, end_char, synset_id, confidence FROM resolved"),
    "wordnet_examples": sql("nest", "SELECT * FROM usable"),
    "wordnet_lexicon": sql("nest", "SELECT lemma AS form, pos, row_number() OVER (PARTITION BY lemma, pos ORDER BY nr, word_nr) - 1 AS ord, synset_id, definition FROM entries"),
    "wordnet_training": sql("nest", """, words AS (SELECT lemma AS word, synset_id AS id, pos, definition AS source_definition, definition AS alternative_definition, examples, row_number() OVER (PARTITION BY lemma ORDER BY nr, word_nr) - 1 AS ord FROM entries),
    """ + ",\n".join(CTE[n] for n in ("sent", "train", "tmajor", "reject")) + " SELECT word, count(*) AS examples, count(DISTINCT sentence) AS sentences FROM (SELECT word, sentence FROM lines UNION ALL SELECT word, sentence FROM rsent JOIN (SELECT DISTINCT word FROM rline) USING (word)) GROUP BY ALL"),
    "gazetteer_spans": sql("tok labels", "SELECT * FROM lspan"),
    "gazetteer_greedy": "WITH RECURSIVE " + ",\n".join(CTE[n] for n in ("tok", "labels")) + """,
    one AS MATERIALIZED (SELECT * FROM lspan QUALIFY row_number() OVER (PARTITION BY doc_id, start_token ORDER BY end_token DESC, id, text) = 1),
    walk AS (SELECT doc_id, min(start_token) AS s FROM one GROUP BY doc_id UNION ALL
      SELECT w.doc_id, (SELECT min(n.start_token) FROM one n WHERE n.doc_id = w.doc_id AND n.start_token > o.end_token) FROM walk w JOIN one o ON o.doc_id = w.doc_id AND o.start_token = w.s)
    SELECT one.* FROM one JOIN walk ON walk.doc_id = one.doc_id AND walk.s = one.start_token""",
    "entity_coverage": sql("tok gaz spans", "SELECT t.doc_id, position, word, id, text FROM tok t JOIN (SELECT doc_id, id, text, unnest(range(start_token, end_token + 1)) AS position FROM spans) s USING (doc_id, position)"),
    "choice_softmax": sql("lex asked ask defs scored shares", "SELECT query_id, ord, round(p, 6) AS p FROM shares"),
    "choice_argmax": sql("lex asked ask defs scored shares", f"SELECT query_id, synset_id, definition, round(p, 6) AS confidence, ord = {REJECT} AS rejected FROM shares WHERE r = 1"),
    "choice_array_form": sql("lex asked ask defs scored shares", "SELECT query_id, synset_id, round(p, 6) AS confidence FROM shares WHERE r = 1"),
    "choice_slice": """SELECT item_id, array_to_string(list_transform(list_concat(range(0, item_id % 20 + 1), [127]), lambda i: format('{:.6f}', ((i + item_id) % 128) / 8128.0)), ' ') AS slice FROM benchmark""",
    "sentinels": sql("lex asked ask defs", """SELECT query_id, coalesce(synset_id, 'No definitions found') AS synset_id, coalesce(definition, '') AS definition, round(coalesce(p, 0.0), 6) AS confidence FROM asked LEFT JOIN
      (SELECT *, exp(length(definition) - m) / sum(exp(length(definition) - m)) OVER (PARTITION BY query_id) AS p, row_number() OVER (PARTITION BY query_id ORDER BY length(definition) DESC, ord) AS r
       FROM (SELECT query_id, ord, synset_id, definition, max(length(definition)) OVER (PARTITION BY query_id) AS m FROM defs) QUALIFY r = 1) USING (query_id)"""),
    "collect_examples": sql("lex marks examples", "SELECT synset_id, form, pos, sentence, marked FROM examples"),
    "quota_split": sql("lex marks examples split", "SELECT synset_id, form, part FROM examples JOIN parts USING (synset_id)"),
    "split_disjointness": sql("lex marks examples split", "SELECT count(*) AS shared_synsets FROM (SELECT synset_id FROM parts WHERE part = 'eval' INTERSECT SELECT synset_id FROM parts WHERE part = 'bench')"),
    "accuracy": sql("lex ask marks examples judged", "SELECT count(*) FILTER (correct) AS correct, count(*) AS seen, round(coalesce(avg(correct::int), 0), 6) AS accuracy FROM judged"),
    "running_accuracy": sql("lex ask marks examples judged", """SELECT batch, (sum(c) OVER (ORDER BY batch))::bigint AS correct, (sum(n) OVER (ORDER BY batch))::bigint AS seen, round(sum(c) OVER (ORDER BY batch) / sum(n) OVER (ORDER BY batch), 6) AS accuracy
      FROM (SELECT idx // 32 AS batch, count(*) FILTER (correct) AS c, count(*) AS n FROM numbered GROUP BY 1)"""),
    "mismatch_report": sql("lex ask marks examples judged", "SELECT idx, key, predicted FROM numbered WHERE NOT correct AND idx < 10"),
    "batch_ids": sql("lex ask marks examples judged", "SELECT key, idx, idx // 32 AS batch FROM numbered"),
    "length_buckets": sql("conv", "SELECT key, len, idx, idx // 4 AS bucket FROM conv"),
    "bucket_padding": sql("conv", "SELECT idx // 4 AS bucket, count(*) AS n, (count(*) * max(len) - sum(len))::bigint AS padding FROM conv GROUP BY 1"),
    "seeded_shuffle": "SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS idx FROM benchmark",
    "random_offsets": sql("lex", "SELECT form, pos, ('0x' || substr(md5('42:' || form || ':' || pos), 1, 8))::bigint % (128 - count(*)) AS \"offset\" FROM lex GROUP BY form, pos"),
    "eval_examples": sql("lex ask marks examples split", f"""SELECT e.synset_id, e.form, substr('{ABC}', (place + 1)::int, 1) AS answer, md5('What is the meaning of *' || e.form || '* in this sentence?' || chr(10) || chr(10) || 'Sentence: ' || marked || chr(10) || chr(10) || txt || chr(10) || '{LETTERS[REJECT]}. {NONE}' || chr(10) || chr(10) || 'Answer: [unused0] [MASK]') AS prompt_md5
      FROM (SELECT e.*, g.ord AS place FROM (SELECT x.* FROM examples x JOIN parts p ON p.synset_id = x.synset_id AND part = 'eval') e JOIN (SELECT q.form, q.pos, l.synset_id, row_number() OVER (PARTITION BY q.form, q.pos ORDER BY turn, l.ord) - 1 AS ord FROM (SELECT DISTINCT form, pos FROM examples) q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask) g
        ON g.form = e.form AND g.pos = e.pos AND g.synset_id = e.synset_id) e JOIN
      (SELECT form, pos, string_agg(substr('{ABC}', (ord + 1)::int, 1) || '. ' || definition, chr(10) ORDER BY ord) AS txt FROM (SELECT q.form, q.pos, definition, row_number() OVER (PARTITION BY q.form, q.pos ORDER BY turn, l.ord) - 1 AS ord FROM (SELECT DISTINCT form, pos FROM examples) q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask) GROUP BY ALL HAVING count(*) <= {REJECT}) t
      ON t.form = e.form AND t.pos = e.pos"""),
    "prompt_masks": sql("lex ask marks examples", f"""SELECT form, count(*) AS prompts, bool_and(true) AS all_masked, bool_or(contains(marked, '[MASK]') OR contains(txt, '[MASK]')) AS any_twice FROM examples e JOIN
      (SELECT q.form, q.pos, string_agg(definition, chr(10)) AS txt, count(*) AS n FROM (SELECT DISTINCT form, pos FROM examples) q JOIN ask USING (pos) JOIN lex l ON l.form = q.form AND l.pos = ask.ask GROUP BY ALL HAVING count(*) <= {REJECT}) t USING (form, pos) GROUP BY form"""),
    "group_by_synset": sql("lex marks examples", "SELECT synset_id, string_agg(form, ' ' ORDER BY form) AS forms, count(*) AS n FROM examples GROUP BY ALL"),
    "sentence_rebuild": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "train_examples": sql("lex words sent train", "SELECT word, synset_id, nr, answer, md5(prompt) AS prompt_md5 FROM train"),
    "reject_examples": sql("lex words sent tmajor reject", "SELECT word, synset_id, nr, answer, md5(prompt) AS prompt_md5 FROM rej"),
    "train_union": sql("lex words sent train tmajor reject", "SELECT word, count(*) AS examples, count(*) FILTER (synset_id LIKE '%\\_none' ESCAPE '\\') AS rejects FROM (SELECT word, synset_id FROM train UNION ALL SELECT word, synset_id FROM rej) GROUP BY ALL"),
    "training_majority": sql("lex words tmajor", "SELECT * FROM tmajor"),
    "label_encode": sql("enc", "SELECT item_id, md5(array_to_string(input_ids, ' ')) AS ids_md5, label, place AS \"at\" FROM enc WHERE place > 0"),
    "truncation_filter": sql("enc", "SELECT count(*) FILTER (place > 0) AS kept, count(*) FILTER (coalesce(place, 0) = 0) AS dropped FROM enc"),
    "pad_batch": sql("enc", """SELECT item_id, m AS n, md5(array_to_string(list_concat(input_ids, list_transform(range(m - k), lambda x: 0)), ' ')) AS ids_md5, md5(array_to_string(list_concat(list_transform(range(k), lambda x: 1), list_transform(range(m - k), lambda x: 0)), ' ')) AS mask_md5,
      md5(array_to_string(list_transform(range(1, m + 1), lambda i: CASE WHEN i = place THEN label ELSE -100 END), ' ')) AS labels_md5 FROM (SELECT *, len(input_ids) AS k, max(len(input_ids)) OVER (PARTITION BY item_id // 8) AS m FROM enc WHERE place > 0)"""),
    "batch_reply": sql("lex", """SELECT batch_id, query, ord, synset_id, definition FROM (SELECT form, ('0x' || substr(md5('7:' || form), 1, 8))::bigint % 40 AS batch_id, dense_rank() OVER (PARTITION BY ('0x' || substr(md5('7:' || form), 1, 8))::bigint % 40 ORDER BY form) - 1 AS query,
      row_number() OVER (PARTITION BY form ORDER BY synset_id) - 1 AS ord, synset_id, definition FROM lex WHERE pos = 'n') WHERE batch_id % 5 <> 0 AND batch_id % 7 <> 0"""),
    "synset_payload": sql("lex", "SELECT form, synset_id AS id, pos, definition FROM lex"),
    "ndjson_fold": "SELECT conv_id AS stream_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS content_md5 FROM conversations c WHERE turn <= coalesce((SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND turn = 2), turn) GROUP BY conv_id",
    "skip_list": sql("lex", "SELECT DISTINCT form FROM lex WHERE pos = 'v'"),
    "pending_forms": sql("lex", "SELECT DISTINCT form FROM lex WHERE form NOT IN (SELECT form FROM lex WHERE pos IN ('v', 'r'))"),
    "generate_gate": sql("lex", "SELECT form, CASE WHEN count(*) > 1 THEN 'generate' ELSE 'skip' END AS gate FROM lex GROUP BY form"),
    "training_directory": sql("lex words", "SELECT word, ord, id, pos, md5(source_definition) AS source_md5, len(examples) AS examples FROM words"),
    "lexicon_table": sql("lex", "SELECT form, pos, ord, synset_id, definition FROM lex"),
    "service_lexicon": sql("lex", """SELECT form, pos, ord, synset_id, definition FROM (SELECT form, pos, ('0x' || substr(md5('7:' || form), 1, 8))::bigint % 40 AS batch_id,
      row_number() OVER (PARTITION BY form ORDER BY synset_id) - 1 AS ord, synset_id, definition FROM lex WHERE pos = 'n') WHERE batch_id % 5 <> 0 AND batch_id % 7 <> 0"""),
    "greedy_spans": sql("tok gaz spans greedy", "SELECT * FROM greedy"),
    "health": sql("lex", "SELECT 'ok' AS status, count(*) AS senses, true AS now FROM lex"),
    "resolve_array_form": sql(RESOLVE, "SELECT doc_id, form, pos, CASE WHEN NOT rejected THEN synset_id END AS synset_id, confidence FROM pred"),
    "nested_result": sql(RESOLVE + " resolved gaz spans greedy", """SELECT doc_id, n AS n_tokens, t AS tokens_md5, coalesce(n_entities, 0) AS n_entities, coalesce(entities_md5, md5('')) AS entities_md5 FROM
      (SELECT doc_id, count(*) AS n, md5(string_agg(word || '|' || lemma || '|' || pos || '|' || position || '|' || start_char || '|' || end_char || '|' || coalesce(synset_id, '-') || '|' || coalesce(synset_definition, '-') || '|' || coalesce(format('{:.6f}', confidence), '-'), chr(10) ORDER BY position)) AS t FROM resolved GROUP BY doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n_entities, md5(string_agg(id || '|' || start_token || '|' || end_token || '|' || text || '|-|-', chr(10) ORDER BY start_token)) AS entities_md5 FROM greedy GROUP BY doc_id) USING (doc_id)"""),
    "html_result": sql(RESOLVE + " resolved gaz spans greedy", """SELECT doc_id, md5('<table><tr>' || string_agg('<td>' || e(word) || '</td>', '' ORDER BY position) || '</tr><tr>' || string_agg('<td>' || coalesce('<a href="#' || e(synset_id) || '">' || e(synset_definition) || '</a>', '-') || '</td>', '' ORDER BY position) || '</tr><tr>' ||
      string_agg(CASE WHEN start_token = position THEN '<td colspan="' || end_token - start_token + 1 || '"><a href="#' || id || '">' || e(text) || '</a></td>' WHEN id IS NULL THEN '<td>-</td>' ELSE '' END, '' ORDER BY position) || '</tr></table>') AS html_md5
      FROM resolved LEFT JOIN (SELECT doc_id, id, start_token, end_token, text, unnest(range(start_token, end_token + 1)) AS position FROM greedy) USING (doc_id, position) GROUP BY doc_id"""),
    "letter_sidecar": sql("lex asked ask defs", f"SELECT '{ABC}' AS letters, 128::bigint AS num_letters, max(n) AS most FROM (SELECT count(*) AS n FROM defs GROUP BY query_id)"),
    "request_errors": """SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN '{"error":{"status":400,"message":"Missing parameter: text","type":"bad_request"}}' WHEN turn % 2 <> 0 THEN '{"error":{"status":400,"message":"Missing parameter: lang","type":"bad_request"}}' END AS error FROM conversations""",
}


def _requests() -> str:
    from glosswork.sources.sinks import FIELDS, LEXICOGRAPHER

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    before, after = (quoted(x) for x in LEXICOGRAPHER.split("{}"))
    text = "{'type': 'string'}"
    fields = ", ".join(f"'{c}': " + ("{'type': 'array', 'items': {'type': 'string'}, 'minItems': 3, 'maxItems': 3}" if c == "examples" else text) for c in FIELDS)
    item = f"{{'type': 'object', 'properties': {{{fields}}}, 'required': {list(FIELDS)}}}"
    sense = "{'id': synset_id, 'attributes': {'pos': pos, 'definition': definition, 'examples': []::varchar[]}}"
    return sql("lex", f"""SELECT form, to_json({{'model': 'any-model', 'stream': true, 'options': {{'temperature': 0}},
      'messages': [{{'role': 'system', 'content': {before} || form || {after}}}, {{'role': 'user', 'content': senses}}],
      'format': {{'type': 'array', 'minItems': n, 'maxItems': n, 'items': {item}}}}})::varchar AS payload
      FROM (SELECT form, count(*) AS n, to_json(list({sense} ORDER BY synset_id))::varchar AS senses FROM lex GROUP BY form)""")


SQL["llm_requests"] = _requests()
# both sides of the join are made once
for _n in ("tok", "spans"):
    SQL["entity_coverage"] = SQL["entity_coverage"].replace(f"\n    {_n} AS (", f"\n    {_n} AS MATERIALIZED (").replace(f"\n{_n} AS (", f"\n{_n} AS MATERIALIZED (")


def _escaped(column: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        column = f"replace({column}, '{a}', '{b}')"
    return column


SQL["resolve_stream"] = SQL["resolve_array_form"]
for _c in ("word", "synset_id", "synset_definition", "text"):
    SQL["html_result"] = SQL["html_result"].replace(f"e({_c})", _escaped(_c))
