"""Ingest: message windows, classification, fact parsing, profiles, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text
from engram.operators import windows

# Limits and patterns of ingest.
WINDOW_BYTES, OVERLAP_BYTES, WINDOW_RANGE = 4096, 800, (128, 16384)
MOST_MESSAGES, MOST_CUBES = 200, 20
TRIVIAL_CHARS, CODE_ONLY, CODE_BIAS = 20, 0.9, 0.3
CASUAL = (
    r"(?i)\A(?:ok|okay|thanks|thank you|got it|yes|no|sure|done|lgtm|thx|ty|ack|k|yep|yup|nope|cool|nice|great|perfect|right|understood|good|fine|alright|np|nw|mhm|"
    r"hmm|hm|ah|oh|wow|lol|haha|ha|btw)\z"
)
CODE_BLOCK = r"(?s)```[a-zA-Z]*\n.*?```"
OPINION = r"(?i)\b(I\s+(prefer|like|think|believe|feel|want|love|hate|dislike|enjoy|wish|hope|need|choose|favor|recommend))\b"
TECHNICAL = (
    r"(?i)\b(docker|kubernetes|postgres|redis|nginx|api|http[s]?|tcp|udp|ssh|git|npm|pip|curl|sudo|systemctl|deploy|server|database|endpoint|middleware|container|"
    r"microservice|grpc|graphql|webhook|dns|ssl|tls|cdn|vpc|yaml|json|toml|env|dockerfile|makefile|cicd|ci/cd)\b"
)
FACT_DATE = (
    r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}(st|nd|rd|th)\s+(of\s+)?(January|February|March|April|May|June|July|August|September|October|November|December)|"
    r"\d{1,2}:\d{2}\s*(am|pm|AM|PM)?)\b"
)
FACT_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
META = r"(?m)^(?:user|assistant|system):\s*\[[^\]]*\]:\s*"
SESSION = {
    "decision": r"(?i)\b(decided|chose|going with|picked|settled on|agreed|concluded|chosen|opting for|decision)\b",
    "learning": r"(?i)\b(TIL|learned|turns out|discovered|realized|found out|never knew|understanding now|interesting)\b",
    "debug": r"(?i)\b(error|bug|fix|fixed|solved|crash|exception|traceback|stack trace|segfault|panic|debug|debugging|broken)\b",
    "planning": r"(?i)\b(plan|roadmap|next steps|TODO|sprint|milestone|timeline|deadline|priorit|backlog|schedule)\b",
}
TOOL_MARKS = ("tool_call", "function_call", "<tool>", "tool:")
PROFILE_LIMITS = (64, 64, 512)
PROFILE_BLOCKED = r"(?i)(ignore (all )?previous|system prompt|<\|im_start\|>|\[inst\]|assistant:|system:|user:|jailbreak)"
FACT_TYPES = ("LongTermMemory", "UserMemory")


def window_size(asked: int | None) -> int:
    """The override if it is in range, else the default."""
    return asked if asked and WINDOW_RANGE[0] <= asked <= WINDOW_RANGE[1] else WINDOW_BYTES


def windows_of(lines: list[tuple[str, str]], size: int = WINDOW_BYTES, overlap: int = OVERLAP_BYTES) -> list[tuple[int, int, str, str]]:
    """(first, end, text, memory type) of greedy windows over (role, line), by bytes.

    The next window starts where about ``overlap`` bytes repeat, at least one line on.
    """
    lengths = [len(t.encode()) + 1 for _, t in lines]
    out, start = [], 0
    while start < len(lines):
        end, used = start, 0
        while end < len(lines) and (not used or used + lengths[end] <= size):
            used += lengths[end]
            end += 1
        kind = "UserMemory" if all(r == "user" for r, _ in lines[start:end]) else "LongTermMemory"
        out.append((start, end, "\n".join(t for _, t in lines[start:end]).strip(), kind))
        if end >= len(lines):
            break
        back, repeated = end, 0
        while back > start + 1 and repeated < overlap:
            back -= 1
            repeated += lengths[back]
        start = max(back, start + 1)
    return out


def _request() -> Column:
    """Messages arrive in requests of MOST_MESSAGES at most; verdicts never cross one, so no group grows with a conversation."""
    return F.floor(F.col("turn") / MOST_MESSAGES).cast("int")


def message_windows(messages: DataFrame, size: int | None = None, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """(conv_id, window, first, end, memory, memory_type) of whole conversations, in turn order, of any length."""
    at = F.coalesce(F.date_format("chat_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("None"))
    role = F.coalesce("role", F.lit(""))
    lines = messages.select("conv_id", "turn", role.alias("role"), F.concat(role, F.lit(": ["), at, F.lit("]: "), F.coalesce("content", F.lit(""))).alias("line"))
    return windows.windows(lines, window_size(size), overlap)


def raw_memories(messages: DataFrame) -> DataFrame:
    """One memory a non-blank message, trimmed."""
    return messages.withColumn("memory", F.trim("content")).where("memory <> ''").select("conv_id", "turn", "role", "memory", F.lit("LongTermMemory").alias("memory_type"))


def skip_known(new: DataFrame, memory: DataFrame) -> DataFrame:
    """Rows whose content hash no active row of the cube has; repeats inside the batch stay."""
    known = memory.where("status = 'activated'").select("user_name", text.content_hash(F.col("memory")).alias("content_hash")).distinct()
    return new.withColumn("content_hash", text.content_hash(F.col("memory"))).join(known, ["user_name", "content_hash"], "left_anti")


def node_pairs(rows: DataFrame) -> DataFrame:
    """Each new memory as a working row and a long-term row bound to it; ids from the content."""
    wm = F.concat(F.lit("w"), F.substring(F.sha2(F.concat_ws("|", "user_name", "memory"), 256), 1, 16))
    base = rows.withColumn("wm_id", wm)
    work = base.select(F.col("wm_id").alias("id"), "user_name", "memory", F.lit("WorkingMemory").alias("memory_type"), F.lit("").alias("background"))
    keep = base.select(F.concat(F.lit("l"), F.expr("substring(wm_id, 2)")).alias("id"), "user_name", "memory", "memory_type", F.concat(F.lit("[working_binding:"), "wm_id", F.lit("]")).alias("background"))
    return work.unionByName(keep)


def unembedded(rows: DataFrame, size: int = 64) -> DataFrame:
    """Rows with a zero vector, whose cosine with everything is 0, until a task embeds them."""
    return rows.withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), size))


def read_later(new: DataFrame) -> DataFrame:
    """A mem_read task (item_id, cube_id, label, content) for each working row stored without a vector."""
    return new.where("memory_type = 'WorkingMemory'").select(F.concat(F.lit("read-"), "id").alias("item_id"), F.col("user_name").alias("cube_id"), F.lit("mem_read").alias("label"), F.to_json(F.struct(F.array("id").alias("memory_ids"))).alias("content"))


def code_ratio(t: Column) -> Column:
    """Share of the text inside fenced code blocks."""
    inside = F.aggregate(F.regexp_extract_all(t, F.lit(CODE_BLOCK), F.lit(0)), F.lit(0), lambda s, x: s + F.octet_length(x))
    return F.when(F.octet_length(t) == 0, 0.0).otherwise(inside / F.octet_length(t))


def content_type(conversation: Column) -> Column:
    t = F.regexp_replace(conversation, META, "")
    opinion = F.regexp_count(t, F.lit(OPINION))
    tech = F.regexp_count(t, F.lit(TECHNICAL)) + F.when(code_ratio(t) > CODE_BIAS, 3).otherwise(0)
    fact = F.regexp_count(t, F.lit(FACT_DATE)) + F.regexp_count(t, F.lit(FACT_NAME))
    return (
        F.when((opinion >= 2) | ((opinion >= 1) & (tech == 0) & (fact == 0)), "opinion")
        .when((tech >= 3) | ((tech >= 2) & (opinion == 0)), "technical")
        .when((fact >= 2) | ((fact >= 1) & (opinion == 0) & (tech == 0)), "factual")
        .otherwise("mixed")
    )


def conversations(messages: DataFrame) -> DataFrame:
    """One row a request of a conversation: messages in turn order, and their formatted text."""
    line = F.concat_ws("", "role", F.lit(": "), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("content", F.lit("")).alias("content"), line.alias("line"))))
    return messages.groupBy("conv_id", _request().alias("request")).agg(ordered.alias("m")).select(
        "conv_id", "request", F.size("m").alias("n"), F.array_join("m.content", "\n").alias("content"), F.array_join("m.line", "\n").alias("conversation"),
        F.exists("m", lambda x: (x["role"] == "user") & (F.trim(x["content"]) != "")).alias("has_user"), F.get("m.content", F.lit(0)).alias("first"),
    )


def classified(convs: DataFrame) -> DataFrame:
    """conversations() with skip_reason (no-user, trivial, code-only or '') and content_type."""
    one = F.trim("first")
    trivial = (F.col("n") == 1) & ((one == "") | ((F.length(one) <= TRIVIAL_CHARS) & one.rlike(CASUAL)))
    skip = F.when(~F.col("has_user"), "no-user").when(trivial, "trivial").when(code_ratio(F.col("content")) > CODE_ONLY, "code-only").otherwise("")
    kind = F.when(skip != "", "").when(F.col("n") > 2, "multi-turn").otherwise(content_type(F.col("conversation")))
    return convs.withColumn("skip_reason", skip).withColumn("content_type", kind)


def classify(convs: DataFrame) -> DataFrame:
    return classified(convs).select("conv_id", "n", "skip_reason", "content_type")


def session_type(conversation: Column) -> Column:
    """The kind with the most keyword hits; ties by the order decision, learning, debug, planning."""
    counts = {k: F.regexp_count(conversation, F.lit(p)) for k, p in SESSION.items()}
    best = F.greatest(*counts.values())
    out = F.lit("general")
    for k, n in reversed(counts.items()):
        out = F.when((n == best) & (best > 0), k).otherwise(out)
    return out


def clean_text_gate(t: Column) -> Column:
    """Text that can be stored as it is: long enough, no JSON, no code, eight words."""
    return (F.octet_length(t) >= 10) & ~t.rlike(r"\A[\[{`]") & ~t.contains("```") & ~t.contains("\n\n\n") & (F.size(F.split(F.trim(t), r"\s+")) >= 8)


def side_job_gates(convs: DataFrame) -> DataFrame:
    """Which side jobs a conversation qualifies for: episodic, skill, tool."""
    code = code_ratio(F.col("content"))
    tool = F.lit(False)
    for m in TOOL_MARKS:
        tool = tool | F.col("conversation").contains(m)
    return convs.select("conv_id", ((code <= 0.8) & (F.length("conversation") >= 100)).alias("episodic"), ((F.col("n") >= 10) & (code <= 0.7)).alias("skill"), tool.alias("tool"))


def parse_facts(raw: DataFrame, column: str = "reply") -> DataFrame:
    """Facts of a model reply: fences stripped, resolved text wins, defaults filled, weak ones dropped."""
    schema = "array<struct<raw_text:string,resolved_text:string,action:string,confidence:double,type:string,target_id:string>>"
    rest = [c for c in raw.columns if c != column]
    f = raw.select(*rest, F.explode(F.from_json(text.strip_fence(F.col(column)), schema)).alias("f"))
    action = F.lower(F.trim("f.action"))
    action = F.when(action.isin("add", "update", "delete", "skip"), action).otherwise("add")
    out = f.select(
        *rest, F.coalesce(F.nullif(F.trim("f.resolved_text"), F.lit("")), F.trim("f.raw_text")).alias("memory"), action.alias("action"), F.coalesce("f.confidence", F.lit(1.0)).alias("confidence"),
        F.when(F.col("f.type").isin(*FACT_TYPES), F.col("f.type")).otherwise("LongTermMemory").alias("memory_type"), F.col("f.target_id").alias("target_id"),
    )
    return out.where((F.col("action") != "skip") & ((F.col("action") == "delete") | ((F.col("confidence") >= 0.65) & (F.coalesce("memory", F.lit("")) != ""))))


def keep_judged(facts: DataFrame, verdicts: DataFrame, key: str = "fact_id") -> DataFrame:
    """Facts without a negative verdict; a missing verdict keeps."""
    return facts.join(verdicts.select(key, F.col("keep").alias("__keep")), key, "left").where(F.coalesce("__keep", F.lit(True))).drop("__keep")


def sanitize_profiles(rows: DataFrame) -> DataFrame:
    """(topic, sub_topic, memo) cleaned: lower case, one line, cut to size; unsafe or empty entries go."""

    def cut(c: Column, n: int) -> Column:
        return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)

    memo = F.trim(F.regexp_replace("memo", r"[\x00-\x1F\x7F]+", " "))
    t = rows.withColumn("topic", F.lower(F.trim("topic"))).withColumn("sub_topic", F.lower(F.trim("sub_topic"))).withColumn("memo", memo)
    t = t.where((F.col("topic") != "") & (F.col("sub_topic") != "") & (F.col("memo") != "") & F.col("topic").rlike("[a-z]") & ~F.col("memo").rlike(PROFILE_BLOCKED))
    for c, n in zip(("topic", "sub_topic", "memo"), PROFILE_LIMITS):
        t = t.withColumn(c, cut(F.col(c), n))
    return t.withColumn("confidence", F.lit(0.9))


def pack_profile(profiles: DataFrame, budget: int = 1000, by: tuple[str, ...] = ("cube_id", "user_id")) -> DataFrame:
    """Profile lines inside a token budget (length / 4), the most confident first, <> escaped."""
    line = F.concat_ws("", F.lit("- "), "topic", F.lit("::"), "sub_topic", F.lit(": "), F.replace(F.replace(F.col("memo"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    w = Window.partitionBy(*by).orderBy(F.desc("confidence"), "topic", "sub_topic", "memo").rowsBetween(Window.unboundedPreceding, 0)
    t = profiles.withColumn("line", line).withColumn("used", F.sum(F.ceil(F.length("line") / 4.0)).over(w))
    return t.where(F.col("used") <= budget).select(*by, "topic", "sub_topic", "line", "used")


def split_feedback(messages: DataFrame) -> DataFrame:
    """The last user message of a request is the feedback, what is before it the history."""
    messages = messages.withColumn("request", _request())
    last = messages.where("role = 'user'").groupBy("conv_id", "request").agg(F.max("turn").alias("at"))
    t = messages.join(last, ["conv_id", "request"])
    line = F.concat_ws(": ", "role", "content")
    before = F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("at"), F.struct("turn", line.alias("line")))))
    return t.groupBy("conv_id", "request").agg(F.max(F.when(F.col("turn") == F.col("at"), F.col("content"))).alias("feedback"), before.alias("m")).select(
        "conv_id", "feedback", F.array_join("m.line", "\n").alias("history")
    )


def fixed_chunks(rows: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, text): blocks of ``size`` white-space tokens; -1 is the whole text."""
    words = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    t = rows.select(id_col, words.alias("w"))
    if size < 0:
        return t.select(id_col, F.lit(0).alias("chunk"), F.array_join("w", " ").alias("text"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(size)))
    return t.select(id_col, "w", at.alias("at")).select(id_col, (F.col("at") / size).cast("int").alias("chunk"), F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("text"))


@dataclass(frozen=True)
class AddRequest:
    """What decides how a request is ingested."""

    n_messages: int
    n_cubes: int = 1
    mode: str = ""
    is_feedback: bool = False
    is_async: bool = False
    buffered: bool = False
    has_model: bool = False


def route(r: AddRequest) -> str:
    """feedback > async > raw > fast > fine > buffer > fine with a model, else fast."""
    if r.n_messages > MOST_MESSAGES or r.n_cubes > MOST_CUBES:
        raise ValueError("too many messages or cubes")
    if r.is_feedback:
        return "feedback"
    if r.is_async:
        return "async"
    if r.mode in ("raw", "fast", "fine"):
        return r.mode
    return "buffer" if r.buffered else "fine" if r.has_model else "fast"
