"""Queries of tokenizers, chunkers, subwords, JSON and conversations. Long results are counted per document or token."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import chunk, json_text, subword, text
from millrace.operators import nested
from millrace.queries.registry import query

_TOKENS = "SELECT doc_id, len(ts)::INT AS n, md5(array_to_string(ts, '|')) AS tokens FROM ({})"


def _tokens(t, tokens):
    """Count and digest of each document's tokens: the whole lists are compared."""
    return t("documents").select("doc_id", tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", "|").cast("binary")).alias("tokens"))


@query(_TOKENS.format(r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM documents"))
def tok_ws(t, spark):
    return _tokens(t, text.by_space)


@query(_TOKENS.format(r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS ts FROM documents"))
def tok_simple(t, spark):
    return _tokens(t, text.words_and_marks)


@query(_TOKENS.format(r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_full_match(x, '[\p{L}\p{N}]+')) AS ts FROM documents"))
def tok_alnum(t, spark):
    return _tokens(t, text.alphanumeric)


@query(_TOKENS.format("SELECT doc_id, list_filter(string_split(text, ''), lambda x: x <> '') AS ts FROM documents"))
def tok_char(t, spark):
    return _tokens(t, text.characters)


@query(_TOKENS.format(r"SELECT doc_id, list_filter(string_split(text, ''), lambda x: x <> '' AND NOT regexp_full_match(x, '\s')) AS ts FROM documents"))
def tok_solid_char(t, spark):
    return _tokens(t, text.solid_characters)


@query(_TOKENS.format(r"SELECT doc_id, string_split(regexp_replace(text, '(\s)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ts FROM documents"))
def tok_keep_space(t, spark):
    return _tokens(t, text.keeping_space)


@query(_TOKENS.format(r"""SELECT doc_id, string_split(regexp_replace(text, '([,.:;?_!"()'']|--|\s)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ts FROM documents"""))
def tok_keep_marks(t, spark):
    return _tokens(t, text.keeping_marks)


@query(_TOKENS.format(r"""SELECT doc_id, list_filter(string_split(regexp_replace(text, '([,.:;?_!"()'']|--|\s)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ts FROM documents"""))
def tok_no_blanks(t, spark):
    return _tokens(t, text.without_blanks)


@query("SELECT doc_id, strlen(text)::INT AS n, (SELECT sum(('0x' || substr(h, 2 * i - 1, 2))::INT) FROM (SELECT unnest(range(1, strlen(text) + 1)) AS i, hex(encode(text)) AS h))::BIGINT AS total FROM documents WHERE doc_id IS NOT NULL")
def tok_byte(t, spark):
    b = t("documents").select("doc_id", text.utf8_bytes(F.col("text")).alias("b"))
    return b.select("doc_id", F.size("b").alias("n"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_SPLIT = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(f"SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM (SELECT {_SPLIT} AS ws FROM documents)) GROUP BY 1")
def word_ngrams(t, spark):
    return text.counted(t("documents"), lambda c: text.ngrams(text.by_space(c), 2), "gram")


@query("SELECT gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM documents) GROUP BY 1")
def char_ngrams(t, spark):
    return text.counted(t("documents"), lambda c: text.char_ngrams(c, 3), "gram")


@query(f"SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_SPLIT}) AS word FROM documents) GROUP BY 1")
def token_freq(t, spark):
    return subword.word_counts(t("documents"))


@query(f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_SPLIT}) AS word FROM documents) GROUP BY 1),
s AS (SELECT n, list_append(list_filter(string_split(word, ''), lambda x: x <> ''), '</w>') AS s FROM w), p AS (SELECT n, s, unnest(range(1, len(s))) AS i FROM s)
SELECT s[i] AS l, s[i + 1] AS r, sum(n)::BIGINT AS n FROM p GROUP BY 1, 2""")
def pair_stats(t, spark):
    return subword.pair_counts(subword.word_counts(t("documents")))


@query(f"SELECT doc_id, len({_SPLIT})::INT AS n FROM documents")
def word_counts(t, spark):
    return t("documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\t-\r ]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, unnest(range(0, len(s)))::INT AS sentence, unnest(s) AS text FROM p""")
def sent_split(t, spark):
    return t("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence", "text"))


@query(r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> ''))::INT AS n FROM documents")
def paragraph_split(t, spark):
    return t("documents").select("doc_id", F.size(text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("n"))


@query()
def chunk_tokens(t, spark):
    d = t("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunk.as_rows(d, chunk.chunks(F.col("text"), 60, 15), "doc_id")


def markdown(c):
    """Every fifth line of a text headed by its first characters, with blank lines between all: documents have none of their own.

    The line stays whole below its heading."""
    lines = F.transform(F.split(c, "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), F.substring(x, 1, 40), F.lit("\n\n"), x)).otherwise(x))
    return F.array_join(lines, "\n\n")


@query()
def chunk_topics(t, spark):
    d = t("documents").select("doc_id", chunk.topic_sections(markdown(F.col("text")), 30, 120).alias("s"))
    return d.select("doc_id", F.posexplode("s").alias("chunk", "x")).select("doc_id", "chunk", "x.title", "x.content")


@query()
def markdown_rows(t, spark):
    """The sections of each text, as a table function yields them."""
    d = t("documents").select("doc_id", markdown(F.col("text")).alias("md"))
    return chunk.section_rows(d, "md").select("doc_id", "place", "title", F.md5(F.encode("content", "UTF-8")).alias("content"))


@query()
def first_two_chunks(t, spark):
    d = t("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunk.first_chunks(chunk.as_rows(d, chunk.chunks(F.col("text"), 60, 15), "doc_id"), 2)


@query()
def recursive_split(t, spark):
    return chunk.as_rows(t("documents"), chunk.recursive_chunks(500)(F.col("text")), "doc_id")


@query()
def bpe_encode(t, spark):
    merges = subword.learnt_bpe(subword.word_counts(t("documents")), 100)
    return t("documents").select("doc_id", subword.bpe_encoder(merges)(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", "|").cast("binary")).alias("tokens"))


@query()
def wordpiece_encode(t, spark):
    vocab = subword.learnt_wordpiece(subword.word_counts(t("documents")), 160)
    return t("documents").select("doc_id", subword.wordpiece_encoder(vocab)(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", "|").cast("binary")).alias("tokens"))


@query()
def rank_token_counts(t, spark):
    """Tokens of each text by the ranks of a public vocabulary."""
    import public_tokenizers

    count = subword.token_counter(ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return t("documents").select("doc_id", count(F.col("text")).alias("n"))


@query()
def unigram(t, spark):
    vocab = set(subword.training_words(t("documents"), most=2000))
    return t("documents").select("doc_id", subword.unigram_encoder(vocab)(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", "|").cast("binary")).alias("tokens"))


@query("SELECT conv_id, turn, 'Summarize.' || chr(10) || text || chr(10) || 'Summary:' AS prompt FROM conversations WHERE role = 'user'")
def wrapped_prompts(t, spark):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", text.wrapped(F.col("text"), "Summarize.\n", "\nSummary:").alias("prompt"))


@query("SELECT p_partkey, 'Part ' || p_name || ' costs ' || p_brand || '.' AS line FROM part")
def template_fill(t, spark):
    return t("part").select("p_partkey", text.filled_template("Part <<name>> costs <<brand>>.", {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("line"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.x.y'), 'unknown') AS xy FROM events")
def json_get(t, spark):
    return t("events").select("event_id", json_text.nested(F.col("props"), "$.k", "none").alias("k"), json_text.nested(F.col("props"), "$.x.y", "unknown").alias("xy"))


@query("SELECT l_orderkey, count(*)::BIGINT AS n, sum(x)::BIGINT AS total FROM (SELECT l_orderkey, unnest(list(l_linenumber)) AS x FROM lineitem GROUP BY 1) GROUP BY 1")
def explode_lists(t, spark):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("xs"))
    literal = lists.select("l_orderkey", F.concat(F.lit("["), F.array_join(F.col("xs").cast("array<string>"), ","), F.lit("]")).alias("s"))
    return literal.select("l_orderkey", F.explode_outer(json_text.int_list(F.col("s"))).alias("x")).groupBy("l_orderkey").agg(F.count("x").alias("n"), F.sum("x").alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS found FROM events")
def json_repair(t, spark):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here {it} is: "), "props", F.lit(" thanks"))).otherwise(F.lit("no {json} here"))
    return t("events").select("event_id", json_text.embedded_json(said).alias("found"))


# Conversations.


@query("""SELECT text AS instruction, t2 AS output, conv_id AS conversation_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS session_id FROM
(SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant'""")
def qa_pairs(t, spark):
    return nested.adjacent_answers(t("conversations"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS source, role FROM conversations")
def role_map(t, spark):
    c = t("conversations").select("conv_id", "turn", nested.mapped_role(F.col("role"), {"user": "human", "assistant": "gpt"}).alias("source"))
    return c.withColumn("role", nested.mapped_role(F.col("source")))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def chat_render(t, spark):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return t("conversations").groupBy("conv_id").agg(rows.alias("m")).select("conv_id", nested.rendered(F.col("m")).alias("text"))


def export_trees(c):
    """conversations as export trees: a chain of nodes, every fifth conversation without a root."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))

    def entry(x, i):
        first = F.when(F.col("conv_id") % 5 > 0, F.lit(nested.ROOT))
        content = F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["text"]).alias("parts")).alias("content"))
        node = F.struct(F.when(i == 0, first).otherwise(name(i - 1)).alias("parent"), F.array(name(i + 1), name(i + 2)).alias("children"), content.alias("message")).cast(nested.NODE)
        return F.struct(name(i).alias("key"), node.alias("value"))

    return c.groupBy("conv_id").agg(F.map_from_entries(F.transform(rows, entry)).alias("mapping")).withColumn("id", F.col("conv_id").cast("string"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, text AS q, lead(role, 1) OVER w AS r1, lead(text, 1) OVER w AS t1, lead(role, 2) OVER w AS r2, lead(text, 2) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (SELECT conv_id, turn, q, CASE WHEN r1 = 'assistant' AND regexp_matches(t1, '[^\t-\r ]') THEN t1 WHEN r2 = 'assistant' AND regexp_matches(t2, '[^\t-\r ]') THEN t2 END AS answer FROM c WHERE role = 'user' AND regexp_matches(q, '[^\t-\r ]'))
SELECT q AS instruction, answer AS output, CASE WHEN conv_id % 5 > 0 THEN conv_id::VARCHAR ELSE 'unknown' END AS conversation_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS session_id FROM a WHERE answer IS NOT NULL""")
def tree_walk(t, spark):
    return nested.question_answers(export_trees(t("conversations")))


@query("""SELECT conv_id, sum(CASE role WHEN 'assistant' THEN 3 ELSE 1 END)::INT AS n, string_agg(CASE role WHEN 'assistant' THEN 'assistant tool assistant' ELSE 'user' END, ' ' ORDER BY turn) AS roles, true AS well_formed FROM conversations GROUP BY 1""")
def tool_format(t, spark):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    call = F.lit('{"name": "lookup", "arguments": {"k": 1}}')
    m = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))

    def told(x):
        answer = F.array(m("function_call", call), m("observation", F.lit("found")), m("gpt", x["text"]))
        return F.when(x["role"] == "assistant", answer).otherwise(F.array(m("human", x["text"])))

    c = t("conversations").groupBy("conv_id").agg(F.flatten(F.transform(rows, told)).alias("m"))
    out = c.select("conv_id", nested.tool_messages(F.col("m"), F.col("conv_id")).alias("messages"))
    return out.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda x: x["role"]), " ").alias("roles"), nested.well_formed(F.col("messages")).alias("well_formed"))


@query("SELECT conv_id, count(*)::INT AS opened, count(*)::INT AS closed FROM conversations GROUP BY 1")
def tag_checks(t, spark):
    tags = nested.tag_counts(F.col("text"), ["<|im_start|>", "<|im_end|>"])
    return chat_render(t, spark).select("conv_id", tags["<|im_start|>"].alias("opened"), tags["<|im_end|>"].alias("closed"))
