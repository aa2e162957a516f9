"""Transcripts: entries, proof of quotes, and a plan of what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Caps in characters, kinds that prove a note or a vote, tools, and words of commands that reach the network.
TEXT_CAP, ARGS_CAP, RESULT_CAP = 4000, 400, 1500
MIN_QUOTE, CONTENT_CAP, MAX_NOTES, MIN_CALLS = 20, 300, 5, 3
PROVING = {"lesson": ["tool_result"], "fact": ["tool_result"], "decision": ["user", "tool_result"], "convention": ["user", "tool_result"]}
HELPFUL_PROOF, NOISE_PROOF = ["tool_result"], ["tool_result", "user"]
EDIT_TOOLS = ["Edit", "Write", "NotebookEdit", "MultiEdit"]
PROVABLE_TOOLS = ["Read", "Grep", "Glob", "NotebookRead", "LSP"]
NETWORK_PROGRAMS = ["curl", "wget", "http", "https", "httpie", "aria2c", "nc", "ncat", "socat", "ssh", "scp", "rsync", "ftp", "sftp", "lynx", "w3m"]
GIT_REMOTE = ["clone", "fetch", "pull", "ls-remote"]
INSTALLERS = ["pip", "pip3", "npm", "pnpm", "yarn", "cargo", "uv"]
LOOPBACK = ["localhost", "127.0.0.1", "::1", "0.0.0.0"]
WEB_WORDS = ["search", "scrape", "crawl", "fetch", "browse", "web"]
WEB_OMITTED = "[web content omitted]"

TOOL = "quillstone"  # the name of the command that reads and writes notes

LINE = "type string, isMeta boolean, isSidechain boolean, isCompactSummary boolean, message struct<content:string>"
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


def entries(lines: DataFrame) -> DataFrame:
    """session, line_no, block, kind (user, assistant, tool_use, tool_result), body, tool, call_id, edited, input of
    transcript lines (session, line_no, raw).

    A line that is not JSON is skipped, as are side-chain lines and, of the user, meta and summary lines.  A
    message's content is a text or a list of blocks."""
    parsed = lines.select("session", "line_no", F.from_json("raw", LINE).alias("j")).where(F.col("j.type").isin("user", "assistant") & F.col("j.message").isNotNull())
    hidden = F.coalesce("j.isMeta", F.lit(False)) | F.coalesce("j.isCompactSummary", F.lit(False))
    parsed = parsed.where(~F.coalesce("j.isSidechain", F.lit(False)) & ~((F.col("j.type") == "user") & hidden))
    content = F.col("j.message.content")
    plain = F.when((F.col("j.type") == "user") & content.isNotNull(), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("id", "name", "input", "tool_use_id", "content")])))
    listed = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.from_json(content, BLOCKS))
    rows = parsed.select("session", "line_no", F.col("j.type").alias("type"), F.posexplode(F.coalesce(listed, plain)).alias("block", "b"))
    user = F.col("type") == "user"
    kind = F.when(F.col("b.type") == "text", F.col("type")).when((F.col("b.type") == "tool_use") & ~user, "tool_use").when((F.col("b.type") == "tool_result") & user, "tool_result")
    parts = F.when(F.startswith(F.ltrim("b.content"), F.lit("[")), F.from_json("b.content", "array<struct<type:string,text:string>>"))
    text = F.when(F.exists(parts, lambda p: p["type"].isNotNull()), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")).otherwise(F.coalesce("b.content", F.lit("")))
    tail = F.when(F.length(text) > RESULT_CAP, F.concat(F.lit("..."), F.right(text, F.lit(RESULT_CAP)))).otherwise(text)
    body = F.when(F.col("b.type") == "text", F.left(F.coalesce("b.text", F.lit("")), F.lit(TEXT_CAP))).when(F.col("b.type") == "tool_use", F.concat(F.coalesce("b.name", F.lit("None")), F.lit(" "), F.left(F.coalesce("b.input", F.lit("{}")), F.lit(ARGS_CAP)))).otherwise(tail)
    path = lambda name: F.nullif(F.get_json_object("b.input", f"$.{name}"), F.lit(""))
    edited = F.when(F.col("b.name").isin(EDIT_TOOLS), F.coalesce(path("file_path"), path("notebook_path")))
    return rows.select("session", "line_no", "block", kind.alias("kind"), body.alias("body"), F.col("b.name").alias("tool"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"), edited.alias("edited"), F.col("b.input").alias("input")).where("kind is not null")


def number(own: DataFrame, offset: Column | int = 0, tool: str = TOOL) -> DataFrame:
    """`n` from 1 of the entries after the offset.  A result is echoed, web or provable as its call is; what came
    from the web is left out and counts as echoed."""
    command = F.coalesce(F.get_json_object("input", "$.command"), F.lit(""))
    name, bash = F.coalesce("tool", F.lit("")), F.col("tool") == "Bash"
    low = F.lower(name)
    echo = name.isin(EDIT_TOOLS) | command.rlike(rf"\b{tool}\s+(recall|remember|memory)\b")
    web = F.when(bash, mentions_network(command, tool)).when(F.startswith(low, F.lit("mcp__")), low.rlike("|".join(WEB_WORDS))).otherwise(low.rlike("web|fetch"))
    provable = F.when(bash, ~network_command(command, tool)).otherwise(name.isin(PROVABLE_TOOLS))
    calls = own.where("kind = 'tool_use'").select("session", "call_id", echo.alias("echo"), web.alias("of_web"), provable.alias("proof"))
    calls = calls.groupBy("session", "call_id").agg(*[F.bool_or(c).alias(c) for c in ("echo", "of_web", "proof")])
    told = own.join(calls, ["session", "call_id"], "left").where(F.col("line_no") > offset)
    result, omitted = F.col("kind") == "tool_result", F.coalesce("of_web", F.lit(False))
    rows = told.withColumns({
        "web": result & omitted, "body": F.when(result & omitted, F.lit(WEB_OMITTED)).otherwise(F.col("body")),
        "echoed": result & (omitted | F.coalesce("echo", F.lit(False))), "provable": ~result | (~omitted & F.coalesce("proof", F.lit(False))),
    })
    w = Window.partitionBy("session").orderBy("line_no", "block")
    return rows.withColumn("n", F.row_number().over(w)).select("session", "n", "line_no", "kind", "body", "tool", "edited", "provable", "echoed", "web")


def mentions_network(command: Column, tool: str = TOOL) -> Column:
    """Whether a command runs a network program, a remote subcommand of git or gh, an installer, or the notes
    command over the web."""
    words = F.transform(F.regexp_extract_all(command, F.lit("[^\\s;|&()<>`'\"${}]+"), F.lit(0)), lambda w: F.substring_index(w, "/", -1))
    at = lambda ok: F.transform(words, lambda w, i: F.when(ok(w), i))
    then = lambda first, later: F.coalesce(F.array_min(at(lambda w: w.isin(first))) < F.array_max(at(lambda w: w.isin(later))), F.lit(False))
    module = F.exists(F.transform(words, lambda w, i: (w == "pip") & (i > 0) & F.coalesce(F.get(words, i - 1) == "-m", F.lit(False))), lambda x: x)
    return F.exists(words, lambda w: w.isin(NETWORK_PROGRAMS)) | then([tool], ["-w", "--web"]) | then(["gh"], ["api"]) | then(["git"], GIT_REMOTE) | then(INSTALLERS, ["install", "add"]) | module


def network_command(command: Column, tool: str = TOOL) -> Column:
    """Whether a command reaches the network, or names an address that is not this machine's."""
    hosts = F.transform(F.regexp_extract_all(command, F.lit("(?i)[a-z][a-z0-9+.-]*://[^\\s'\"<>)]+"), F.lit(0)), lambda u: F.substring_index(F.regexp_extract(u, "://([^/?#]*)", 1), "@", -1))
    bare = F.transform(hosts, lambda h: F.lower(F.when(F.startswith(h, F.lit("[")), F.regexp_extract(h, "^\\[([^\\]]*)", 1)).otherwise(F.substring_index(h, ":", 1))))
    return mentions_network(command, tool) | F.exists(bare, lambda h: (h != "") & ~h.isin(LOOPBACK))


def injected_notes(lines: DataFrame) -> DataFrame:
    """session, note_id, kind, content of notes `[kind #id] (...) content` that attachments and system lines of a
    transcript showed, the last one of an id."""
    shown = lines.where(F.get_json_object("raw", "$.type").isin("attachment", "system"))
    text = F.replace(F.replace("raw", F.lit('\\"'), F.lit("\x02")), F.lit("\\n"), F.lit("\n"))
    found = F.regexp_extract_all(text, F.lit(r'(?m)(?:^|")(\[\w+ #[0-9]+\](?: \([^)]*\))*[ \t]*[^"\n]*)'), F.lit(1))
    rows = shown.select("session", "line_no", F.posexplode(found).alias("k", "s"))
    part = lambda i: F.regexp_extract("s", r"^\[(\w+) #([0-9]+)\](?: \([^)]*\))*\s*(.*)$", i)
    own = rows.select("session", "line_no", "k", part(2).cast("long").alias("note_id"), part(1).alias("kind"), F.replace(part(3), F.lit("\x02"), F.lit('"')).alias("content"))
    return own.groupBy("session", "note_id").agg(F.max_by(F.struct("kind", "content"), F.struct("line_no", "k")).alias("v")).select("session", "note_id", "v.*")


def render(own: DataFrame, cap: int) -> DataFrame:
    """session, text: all entries (numbered n from 1) if they fit; else the first ones up to a third of the cap, a line that
    says which are left out, and the last ones up to the rest."""
    line = F.concat(F.lit("[#"), F.col("n").cast("string"), F.lit("] "), "kind", F.lit(": "), "body")
    rows = own.withColumn("line", line).withColumn("len", F.length("line") + 1)
    w = Window.partitionBy("session")
    up, down = w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0), w.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"head": F.sum("len").over(up), "tail": F.sum("len").over(down), "all": F.sum("len").over(w), "last": F.max("n").over(w)})
    # The head's own length, known by window, is what the tail leaves to it.
    rows = rows.withColumn("first", F.coalesce(F.max(F.when(F.col("head") <= cap // 3, F.col("head"))).over(w), F.lit(0)))
    fits = F.col("all") <= cap
    in_head = fits | (F.col("head") <= cap // 3)
    in_tail = ~in_head & (F.col("tail") <= cap - F.col("first"))
    lines = lambda x: F.array_join(F.transform(F.array_sort(x), lambda y: y["line"]), "\n")
    told = rows.groupBy("session").agg(
        F.collect_list(F.when(in_head, F.struct("n", "line"))).alias("h"), F.collect_list(F.when(in_tail, F.struct("n", "line"))).alias("t"), F.min(F.when(in_tail, F.col("n"))).alias("from"),
        F.first("last").alias("last"), F.first(fits).alias("fits"),
    )
    gap = F.format_string("[... entries #%d-#%d omitted ...]", F.size("h").cast("long") + 1, F.coalesce(F.col("from") - 1, F.col("last")).cast("long"))
    some = lambda x: F.when(F.size(x) > 0, lines(x))
    return told.select("session", F.when(F.col("fits"), lines("h")).otherwise(F.concat_ws("\n", some("h"), gap, some("t"))).alias("text"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def proofs(claims: DataFrame, own: DataFrame) -> DataFrame:
    """claims (session, claim_no, kind, entry, quote, ...) with `cited`, `proven` and `source`.

    A quote of MIN_QUOTE characters or more is cited where it stands, white space aside, in its entry, which must not
    echo notes and, as a result, must be provable; `source` is that entry's body.  It proves its note where
    the entry is of a kind that proves the note's kind."""
    allowed = F.create_map(*[x for k, v in PROVING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    e = own.select("session", F.col("n").alias("entry"), F.col("kind").alias("entry_kind"), "body", "provable", "echoed")
    quote = squeeze(F.col("quote"))
    ok = (F.length(quote) >= MIN_QUOTE) & F.contains(squeeze(F.col("body")), quote) & ~F.col("echoed") & ((F.col("entry_kind") != "tool_result") | F.col("provable"))
    told = claims.join(e, ["session", "entry"], "left").withColumn("cited", F.coalesce(ok, F.lit(False)))
    proven = F.col("cited") & F.coalesce(F.array_contains(F.element_at(allowed, F.col("kind")), F.col("entry_kind")), F.lit(False))
    return told.withColumns({"proven": proven, "source": F.when(F.col("cited"), F.col("body"))}).drop("body", "provable", "echoed")


def settle(proven: DataFrame, edited: DataFrame) -> DataFrame:
    """Unproven notes become episodes.  Episodes have no anchors and supersede nothing; anchors of the others are kept of
    edited files only.  `evidence` is the citation, if there is one."""
    paths = edited.groupBy("session").agg(F.collect_set("edited").alias("paths"))
    rows = proven.join(paths, "session", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    tied = F.filter("anchors", lambda a: F.array_contains("paths", F.split_part(a, F.lit(":"), F.lit(1))))
    return rows.withColumns({
        "kind": F.when(F.col("proven"), F.col("kind")).otherwise("episode"), "supersedes": F.when(F.col("proven"), F.col("supersedes")), "content": F.left("content", F.lit(CONTENT_CAP)),
        "anchors": F.when(F.col("proven"), tied).otherwise(F.array().cast("array<string>")), "evidence": F.when(F.col("cited"), citation(F.col("entry"), squeeze(F.col("quote")))),
    }).drop("paths")


def plan(settled: DataFrame) -> DataFrame:
    """The first five notes of each session."""
    return settled.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("claim_no"))).where(F.col("k") <= MAX_NOTES).drop("k")


def replaceable(planned: DataFrame, shown: DataFrame, stale: DataFrame) -> DataFrame:
    """The plan, superseding only notes (session, note_id) that its session was shown, stale ones included."""
    may = shown.select("session", F.col("note_id").alias("supersedes")).union(stale.select("session", "note_id")).distinct().withColumn("may", F.lit(True))
    return planned.join(may, ["session", "supersedes"], "left").withColumn("supersedes", F.when(F.col("may"), F.col("supersedes"))).drop("may")


def proven_votes(votes: DataFrame, own: DataFrame, shown: DataFrame, stale: DataFrame) -> DataFrame:
    """session, note_id, helpful of votes (session, note_id, helpful, entry, quote) whose quotes hold, on notes that the
    session was shown and that are not stale.  Results prove both kinds, the user's words noise only."""
    told = proofs(votes.withColumns({"kind": F.lit("vote"), "claim_no": F.lit(0)}), own)
    kinds = F.when(F.col("helpful"), F.col("entry_kind").isin(HELPFUL_PROOF)).otherwise(F.col("entry_kind").isin(NOISE_PROOF))
    fresh = shown.select("session", "note_id").distinct().join(stale.select("session", "note_id"), ["session", "note_id"], "left_anti")
    return told.where(F.col("cited") & kinds).join(fresh, ["session", "note_id"], "left_semi").select("session", "note_id", "helpful")


def reaffirmable(claims: DataFrame, own: DataFrame, stale: DataFrame, planned: DataFrame) -> DataFrame:
    """session, note_id, content, evidence, source of the first claim (session, claim_no, note_id, entry, quote) for each
    stale note (session, note_id, content) that the plan does not supersede and a result proves."""
    told = proofs(claims.withColumn("kind", F.lit("reaffirm")), own).where(F.col("cited") & (F.col("entry_kind") == "tool_result"))
    taken = planned.where("supersedes is not null").select("session", F.col("supersedes").alias("note_id"))
    due = told.join(stale.select("session", "note_id", "content"), ["session", "note_id"]).join(taken, ["session", "note_id"], "left_anti")
    first = due.withColumn("k", F.row_number().over(Window.partitionBy("session", "note_id").orderBy("claim_no"))).where("k = 1")
    return first.select("session", "note_id", "content", citation(F.col("entry"), squeeze(F.col("quote"))).alias("evidence"), "source")


def reducers(own: DataFrame) -> DataFrame:
    """session, first_prompt, tool_calls, edited: what decides whether a session is worth capturing."""
    return own.groupBy("session").agg(F.min_by(F.when(F.col("kind") == "user", F.col("body")), F.when(F.col("kind") == "user", F.col("n"))).alias("first_prompt"), F.count_if(F.col("kind") == "tool_use").alias("tool_calls"), F.array_sort(F.collect_set("edited")).alias("edited"))


def citation(entry: Column, quote: Column) -> Column:
    return F.concat(F.lit("[#"), entry.cast("string"), F.lit("] "), quote)


def verify_gate(settled: DataFrame, scores: DataFrame | None, threshold: float = 0.5) -> DataFrame:
    """Notes whose evidence a verifier (session, claim_no, score) does not support become episodes, as do those
    it fails on; with no verifier they stay."""
    if scores is None:
        return settled
    ok = F.coalesce(F.col("score") >= threshold, F.lit(False)) | (F.col("kind") == "episode")
    return settled.join(scores, ["session", "claim_no"], "left").withColumns({"kind": F.when(ok, F.col("kind")).otherwise("episode"), "supersedes": F.when(ok, F.col("supersedes")), "anchors": F.when(ok, F.col("anchors")).otherwise(F.array().cast("array<string>"))}).drop("score")


def due_sessions(reduced: DataFrame, state: DataFrame) -> DataFrame:
    """Sessions with enough calls, and the line from which each goes on (state: session, offset)."""
    return reduced.where(F.col("tool_calls") >= MIN_CALLS).join(state, "session", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))


def commit_offsets(state: DataFrame, lines: DataFrame) -> DataFrame:
    """session, offset: how far each session (session, line_no) has been read; an offset never goes back."""
    read = lines.groupBy("session").agg(F.max("line_no").cast("long").alias("offset"))
    return state.select("session", F.col("offset").cast("long").alias("offset")).unionByName(read).groupBy("session").agg(F.max("offset").alias("offset"))


def commit_marks(marked: DataFrame, cast: DataFrame) -> DataFrame:
    """The votes already cast (session, note_id) with those of this run."""
    return marked.select("session", "note_id").unionByName(cast.select("session", "note_id")).distinct()


def unmarked(votes: DataFrame, marked: DataFrame) -> DataFrame:
    """Votes (session, note_id, helpful) of notes not yet voted on in their session."""
    return votes.dropDuplicates(["session", "note_id"]).join(marked, ["session", "note_id"], "left_anti")


def plan_commands(planned: DataFrame, injected: DataFrame, proven_votes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remember, supersede, vote) commands of a plan; only notes that the session was shown can be superseded
    or voted on."""
    shown = injected.select("session", "note_id").distinct()
    remember = planned.select("session", "claim_no", "kind", "content", "anchors", F.lit("capture").alias("source"), citation(F.col("entry"), F.col("quote")).alias("evidence"))
    supersede = planned.where("supersedes is not null").join(shown.withColumnRenamed("note_id", "supersedes"), ["session", "supersedes"], "left_semi").select("session", "claim_no", F.col("supersedes").alias("old_id"))
    return remember, supersede, proven_votes.where("proven").join(shown, ["session", "note_id"], "left_semi").select("session", "note_id", "helpful")


def prompts(rendered: DataFrame, existing: DataFrame, stale: DataFrame) -> DataFrame:
    """session, prompt: existing and stale notes (session, note_id, kind, content), then the transcript."""
    line = F.format_string("- #%d [%s] %s", "note_id", "kind", "content")
    block = lambda df, name: df.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias(name))
    both = rendered.join(block(existing, "old"), "session", "left").join(block(stale, "due"), "session", "left")
    part = lambda head, name: F.when(F.col(name).isNotNull(), F.concat(F.lit(head), name, F.lit("\n\n"))).otherwise("")
    return both.select("session", F.concat(part("Existing notes:\n", "old"), part("Stale notes:\n", "due"), F.lit("Transcript:\n"), "text").alias("prompt"))


def repo_relative(path: Column, root: Column) -> Column:
    """The path below the root; null if it is elsewhere."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).when(~F.startswith(path, F.lit("/")), path)
