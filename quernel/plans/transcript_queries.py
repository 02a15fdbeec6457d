"""Queries of transcripts: reading JSON lines, mining them, and the state that lets a run skip what is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernel.operators import mining
from quernel.plans.book import Book
from quernel.sources import transcripts
from quernel.sources.tables import table

BOOK = Book()
q = BOOK.query

#: What is said before the conversations' own words, by turn.
_USER = ("I prefer tabs over spaces. ", "Always run the tests first. ", "No, that is plainly wrong. ", "We should also cache it. ", "The bug here was surely caused by a race! ",
         "You should not have removed it. Please don't use globals? ", "")
_AGENT = ("Fixed by pinning the version. ", "This workaround holds. ", "", "", "")
_TOOLS = ("Bash", "Read", "Edit")


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


_SAYS = f"CASE role WHEN 'user' THEN {_case('(conv_id + turn) % 7', _USER)} ELSE {_case('(conv_id + turn) % 5', _AGENT)} END || coalesce(text, '')"
_TOOL = _case("conv_id % 3", _TOOLS)
_CALL = "json_object('type', 'tool_use', 'name', tool)"
_SAID = "json_object('type', 'thinking', 'thinking', 'hm'), json_object('type', 'text', 'text', says)"
LINES = f"""spoken AS (SELECT conv_id, turn, role, {_SAYS} AS says, {_TOOL} AS tool, (conv_id * 5 + turn * 3) % 13 AS j FROM conversations),
 whole AS (SELECT *, CASE WHEN j = 0 THEN json_object('type', 'system', 'note', says) WHEN j = 3 THEN json_object('type', role, 'message', json_object('content', 5))
 WHEN role = 'user' THEN json_object('type', role, 'message', json_object('role', role, 'content', says))
 WHEN turn % 4 = 1 THEN json_object('type', role, 'message', json_object('content', json_array({_SAID}, {_CALL}, {_CALL})))
 ELSE json_object('type', role, 'message', json_object('content', json_array({_SAID}, {_CALL}))) END AS line FROM spoken),
 lines AS (SELECT conv_id, turn, CASE j WHEN 1 THEN left(CAST(line AS VARCHAR), 20) WHEN 2 THEN '  ' ELSE CAST(line AS VARCHAR) END AS line FROM whole)"""


def _lines(spark, d):
    """Conversations as a session's JSON lines, with metadata, odd contents, cut and blank lines among them."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.expr(_SAYS).alias("says"), F.expr(_TOOL).alias("tool"))
    none = F.lit(None).cast("string")
    part = lambda kind, thinking=none, text=none, name=none: F.struct(F.lit(kind).alias("type"), thinking.alias("thinking"), text.alias("text"), name.alias("name"))
    call = part("tool_use", name=F.col("tool"))
    said = (part("thinking", thinking=F.lit("hm")), part("text", text=F.col("says")))
    parts = F.when(F.col("turn") % 4 == 1, F.array(*said, call, call)).otherwise(F.array(*said, call))
    line = lambda *c: F.to_json(F.struct(*c))
    j, role = (F.col("conv_id") * 5 + F.col("turn") * 3) % 13, F.col("role").alias("type")
    whole = (
        F.when(j == 0, line(F.lit("system").alias("type"), F.col("says").alias("note"))).when(j == 3, line(role, F.struct(F.lit(5).alias("content")).alias("message")))
        .when(F.col("role") == "user", line(role, F.struct("role", F.col("says").alias("content")).alias("message"))).otherwise(line(role, F.struct(parts.alias("content")).alias("message")))
    )
    whole = c.select("conv_id", "turn", j.alias("j"), F.explode(F.array(whole)).alias("line"))
    return whole.select("conv_id", "turn", F.when(F.col("j") == 1, F.left("line", F.lit(20))).when(F.col("j") == 2, "  ").otherwise(F.col("line")).alias("line"))


MESSAGES = f"""{LINES}, record AS (SELECT conv_id, turn, line, TRY_CAST(line AS JSON) AS r FROM lines WHERE regexp_matches(line, '\\S')),
 content AS (SELECT conv_id, turn, r ->> '$.type' AS kind, r -> '$.message.content' AS c, CASE WHEN r IS NULL THEN line END AS corrupt FROM record),
 parts AS (SELECT *, CASE json_type(c) WHEN 'ARRAY' THEN CAST(c AS JSON[]) END AS p FROM content WHERE corrupt IS NOT NULL OR kind IN ('user', 'assistant')),
 messages AS (SELECT conv_id, turn, kind, CASE WHEN corrupt IS NULL THEN CASE WHEN p IS NOT NULL THEN array_to_string(list_transform(list_filter(p, lambda x: (x ->> '$.type') IN ('text', 'tool_use')),
 lambda x: CASE x ->> '$.type' WHEN 'text' THEN x ->> '$.text' ELSE '[tool_use: ' || (x ->> '$.name') || ']' END), ' ') WHEN json_type(c) = 'VARCHAR' THEN c ->> '$' ELSE '' END END AS text,
 CASE WHEN corrupt IS NULL THEN CASE WHEN kind = 'assistant' AND p IS NOT NULL THEN list_transform(list_filter(p, lambda x: (x ->> '$.type') = 'tool_use'), lambda x: x ->> '$.name') ELSE [] END END AS tools, corrupt FROM parts)"""


def _messages(spark, d):
    return transcripts.messages(_lines(spark, d), "conv_id", "turn")


@q(f"WITH {MESSAGES} SELECT conv_id, turn, kind, text, array_to_string(tools, ',') AS tools, corrupt FROM messages")
def transcript_messages(spark, d):
    return _messages(spark, d).withColumn("tools", F.array_join("tools", ","))


def _slug_sql(text: str) -> str:
    return f"array_to_string(list_slice(regexp_extract_all(lower({text}), '[a-z0-9]+'), 1, 6), '-')"


def _mined_sql(source: str) -> str:
    """All of mining over a table of messages: every pattern's matches and the pieces between give the places."""
    found = []
    for f, (family, category, who, patterns) in enumerate(mining.FAMILIES):
        for i, (pattern, why) in enumerate(patterns):
            p = "(?i)" + pattern.replace("'", "''")
            kinds = ", ".join(f"'{w}'" for w in who)
            found.append(f"""SELECT conv_id, turn, text, {f} AS f, {i} AS p, '{family}' AS family, '{category}' AS category, '{why}' AS rationale,
 regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM {source} WHERE kind IN ({kinds}) AND corrupt IS NULL""")
    return f"""found AS ({" UNION ALL ".join(found)}),
 placed AS (SELECT *, m[i] AS said, coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
 windowed AS (SELECT *, CAST(greatest(0, start - 80) AS BIGINT) AS low, CAST(least(length(text), start + length(said) + 80) AS BIGINT) AS high FROM placed),
 shown AS (SELECT *, CASE WHEN low > 0 THEN '...' ELSE '' END || regexp_replace(regexp_replace(substr(text, low + 1, high - low), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') || CASE WHEN high < length(text) THEN '...' ELSE '' END AS excerpt,
 regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS word FROM windowed),
 named AS (SELECT conv_id, turn, f, p, i, category, rationale,
 CASE WHEN category = 'preferences' THEN {_slug_sql('word')} ELSE {_slug_sql('left(excerpt, 60)')} END AS slug,
 CASE WHEN family = 'preference' AND rationale <> '{mining.BARE}' THEN 'HIGH' ELSE 'MEDIUM' END AS first_confidence,
 CASE family WHEN 'preference' THEN left(word, 80) WHEN 'correction' THEN 'Correction: ' || left(word, 60) WHEN 'idea' THEN left(excerpt, 80) ELSE 'Fix: ' || left(excerpt, 60) END AS title,
 CASE family WHEN 'preference' THEN 'User stated: ' WHEN 'correction' THEN 'User corrected the agent: ' WHEN 'fix' THEN 'Fix observed: ' ELSE '' END || excerpt AS body FROM shown),
 ordered AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, category, slug) AS occurrences FROM named WINDOW w AS (PARTITION BY conv_id, category, slug ORDER BY turn, f, p, i)),
 calls AS (SELECT conv_id, tool, count(*) AS n FROM (SELECT conv_id, unnest(tools) AS tool FROM {source} WHERE kind = 'assistant' AND text <> '') GROUP BY 1, 2 HAVING count(*) >= 3),
 mined AS (SELECT conv_id, category, slug, CASE WHEN first_confidence = 'MEDIUM' AND occurrences < CASE category WHEN 'idea' THEN 2 ELSE 3 END THEN 'LOW' ELSE first_confidence END AS confidence, title, body, rationale, occurrences FROM ordered WHERE k = 1
 UNION ALL SELECT conv_id, 'workflow', {_slug_sql("'workflow ' || tool")}, 'MEDIUM', 'Workflow: ' || tool || ' used ' || n || 'x', 'The `' || tool || '` tool was invoked ' || n || ' times during this session. If this represents a repeatable workflow, capture the sequence + when to use it.',
 'tool_use frequency threshold (N>=3, observed ' || n || ')', n FROM calls)"""


def _mined(messages):
    return mining.candidates(messages.where("corrupt IS NULL"), "conv_id", "turn")


@q(f"WITH {MESSAGES}, {_mined_sql('messages')} SELECT * FROM mined")
def transcript_mining(spark, d):
    return _mined(_messages(spark, d))


@q(f"WITH {MESSAGES}, open AS (SELECT * FROM messages WHERE conv_id % 3 <> 0), {_mined_sql('open')} SELECT conv_id, count(*) AS messages, coalesce(any_value(memories), 0) AS memories, coalesce(any_value(ideas), 0) AS ideas, 'done' AS status FROM open LEFT JOIN (SELECT conv_id, count(*) FILTER (category <> 'idea') AS memories, count(*) FILTER (category = 'idea') AS ideas FROM mined GROUP BY 1) USING (conv_id) WHERE corrupt IS NULL GROUP BY 1")
def transcript_state(spark, d):
    state = table(spark, d, "conversations").select("conv_id").distinct().withColumn("status", F.when(F.col("conv_id") % 3 == 0, "done").when(F.col("conv_id") % 3 == 1, "error"))
    messages = mining.unmined(_messages(spark, d), state, "conv_id").where("corrupt IS NULL")
    return mining.session_states(messages, _mined(messages), "conv_id")
