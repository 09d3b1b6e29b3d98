"""Cleaning and labelling of what agents write, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How injected user messages start.
BOILERPLATE = (
    "# AGENTS.md instructions for ",
    "<command-name>",
    "<command-args>",
    "<command-message>",
    "<system-reminder>",
    "<INSTRUCTIONS>",
    "<environment_context>",
    "<permissions instructions>",
    "<collaboration_mode>",
    "<local-command-caveat>",
    "<local-command-stdout>",
    "<local-command-stderr>",
    "You are Codex, a coding agent",
    "Knowledge cutoff:",
)
GOAL_OPEN = '<codex_internal_context source="goal">'
GOAL_CLOSE = "</codex_internal_context>"
RALPH_MARKER = "<command-name>/ralph-loop:ralph-loop</command-name>"

_BLANKS = r"[ \t\r\n]"
_TAGS = "|".join(p[1:-1] for p in BOILERPLATE if p.startswith("<"))


def _ltrim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_BLANKS}+", "")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sanitize(c: Column) -> Column:
    """Without terminal escapes and control characters; tabs and line ends stay."""
    c = F.regexp_replace(c, "\x1b\\[[0-?]*[ -/]*[@-~]", "")
    c = F.regexp_replace(c, "\x1b[@-_]", "")
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def let(c: Column, f) -> Column:
    """f of c, with c evaluated once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def starts_as_boilerplate(c: Column) -> Column:
    """Whether a text starts as an injected message does, to the letter."""
    return c.rlike("^(?:" + "|".join(re.escape(p) for p in BOILERPLATE) + ")")


def clean_prompt(c: Column) -> Column:
    """What follows the wrappers at the start; all of it where a wrapper does not close, the start is no wrapper, or nothing follows."""

    def stripped(whole):
        rest = F.regexp_replace(_ltrim(whole), f"^(?:<({_TAGS})>[\\s\\S]*?</\\1>{_BLANKS}*)+", "")
        return let(rest, lambda r: F.when((r == "") | starts_as_boilerplate(r), whole).otherwise(r))

    return let(sanitize(c), stripped)


def is_boilerplate(c: Column) -> Column:
    return starts_as_boilerplate(_ltrim(clean_prompt(c)))


def is_goal(c: Column) -> Column:
    return _ltrim(sanitize(c)).startswith(GOAL_OPEN)


def _goal_inner(c: Column) -> Column:
    s = sanitize(c)
    return F.regexp_replace(F.regexp_replace(s, '(?s)^.*?<codex_internal_context source="goal">', ""), "(?s)</codex_internal_context>.*$", "")


def goal_objective(c: Column) -> Column:
    """What a person asked for inside a goal wrapper; null without wrapper or objective."""
    return F.when(is_goal(c), F.nullif(_trim(F.regexp_extract(_goal_inner(c), "(?s)<objective>(.*?)</objective>", 1)), F.lit("")))


def goal_budget(c: Column) -> Column:
    """The paragraph that starts at 'Budget:'; empty without."""
    return F.when(is_goal(c), _trim(F.regexp_extract(_goal_inner(c), r"(?s)(Budget:.*?)(\n\n|$)", 1))).otherwise(F.lit(""))


def goal_scaffold(c: Column) -> Column:
    rest = F.regexp_replace(_goal_inner(c), "(?s)^(.*?)<objective>.*?</objective>", "$1")
    return F.when(is_goal(c), _trim(F.regexp_replace(rest, r"(?s)^(.*?)Budget:.*?(?:\n\n[\r\n]*|$)", "$1"))).otherwise(F.lit(""))


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def first_prompt(c: Column, n: int = 200) -> Column:
    """The line shown for a session; null for what nobody wrote."""

    def shown(cleaned):
        line = F.trim(F.regexp_replace(cleaned, r"\s+", " "))
        return let(line, lambda x: F.when(~starts_as_boilerplate(_ltrim(clean_prompt(cleaned))) & (x != ""), shortened(x, n)))

    return let(let(c, lambda x: F.coalesce(goal_objective(x), x)), lambda t: let(clean_prompt(t), shown))


def first_human(texts: Column) -> Column:
    """The first of an array of texts that is no boilerplate, cleaned; '' without."""
    ok = F.filter(F.transform(texts, lambda x: _trim(clean_prompt(x))), lambda x: (x != "") & ~is_boilerplate(x))
    return F.coalesce(F.get(ok, F.lit(0)), F.lit(""))


_WRAPPERS = ("command-name", "command-args", "command-message", "environment_context", "INSTRUCTIONS", "collaboration_mode", "local-command-caveat", "local-command-stdout", "local-command-stderr")


def _without(s: Column, name: str, pattern: str, keep: str = "$1") -> Column:
    """s, a struct of work and parts, with a part taken out of the work."""
    every = keep == ""
    part = F.regexp_extract_all(s["work"], F.lit(pattern), F.lit(1)) if every else F.slice(F.regexp_extract_all(s["work"], F.lit(pattern), F.lit(1)), 1, 1)
    rest = F.regexp_replace(s["work"], pattern, "") if every else F.regexp_replace(s["work"], f"(?s)^(.*?){pattern.replace('(', '(?:', 1)}", "$1")
    return F.struct(rest.alias("work"), F.map_concat(s["parts"], F.create_map(F.lit(name), F.transform(part, _trim))).alias("parts"))


def _taking(name: str, pattern: str, keep: str):
    return lambda s: _without(s, name, pattern, keep)


_NAMES = {"command-name": "command", "system-reminder": "reminders", "environment_context": "env_context"}


def user_message(c: Column) -> Column:
    """A struct of the parts that agents wrap into a user's message, and what is left as `body`."""

    def parsed(x):
        work = F.when(is_goal(x), F.coalesce(goal_objective(x), F.lit(""))).otherwise(sanitize(x))
        state = F.struct(work.alias("work"), F.create_map().cast("map<string,array<string>>").alias("parts"))
        steps = [("permissions_instructions", "<permissions instructions>([^<]*)", "$1")]
        for tag in (*_WRAPPERS[:3], "system-reminder", *_WRAPPERS[3:]):
            steps.append((_NAMES.get(tag, tag.lower().replace("-", "_")), f"<{tag}>([\\s\\S]*?)</{tag}>", "" if tag == "system-reminder" else "$1"))
        for step in steps:
            state = let(state, _taking(*step))
        one = lambda s, name: F.coalesce(F.get(s["parts"].getItem(name), F.lit(0)), F.lit(""))
        return let(state, lambda s: F.struct(
            *[(s["parts"].getItem(n) if n == "reminders" else one(s, n)).alias(n) for n, _, _ in steps],
            F.coalesce(goal_objective(x), F.lit("")).alias("goal_objective"), goal_budget(x).alias("goal_budget"), goal_scaffold(x).alias("goal_scaffold"), _trim(s["work"]).alias("body"),
        ))

    return let(c, parsed)


PREVIEW_LINES, PREVIEW_BYTES = 40, 4096


@F.pandas_udf(StringType())
def preview(texts: pd.Series) -> pd.Series:
    """At most 40 lines and 4096 bytes of UTF-8, cut between characters, then '…' on a line of its own."""

    def one(s):
        if not s:
            return s
        out = "\n".join(s.split("\n")[:PREVIEW_LINES])
        cut = out.encode()[:PREVIEW_BYTES].decode("utf-8", "ignore")
        return cut if len(cut) == len(s) else cut + "\n…"

    return texts.map(one, na_action="ignore")


def capped_lines(c: Column, n: int) -> Column:
    lines = F.split(c, "\n")
    return F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n…"))).otherwise(c)


def display_text(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"\p{C}", "")


# -- projects and models -----------------------------------------------------------------------


def normal_remote(c: Column) -> Column:
    """owner/repo of a remote; anything else as it is."""
    r = _trim(c)
    r = F.when(r.startswith("git@"), F.regexp_replace(r, "^[^:]*:", "")).when(r.rlike("^(ssh|https?)://"), F.regexp_replace(r, "^(ssh|https?)://[^/]*/", "")).otherwise(r)
    return F.regexp_replace(F.regexp_replace(r, r"\.git$", ""), "^/+|/+$", "")


def project_label(marker: Column, remote: Column, path: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.coalesce(F.nullif(marker, F.lit("")), F.nullif(normal_remote(F.nullif(remote, F.lit(""))), F.lit("")), F.when(~base.isin("", "."), base), F.lit("(unscoped)"))


def short_home(c: Column) -> Column:
    return F.regexp_replace(_trim(c), "^/(?:Users|home)/[^/]*", "~")


def remote_link(c: Column) -> Column:
    """(label, url, provider) of a GitHub or GitLab remote; else the path shortened and two empty texts."""
    raw = F.regexp_replace(_trim(c), r"\.git$", "")
    pattern = r"^(?:git@([^:]+):|https?://(?:[^/@]*@)?([^/:]+)(?::\d+)?/)(?:.*/)?([^/]+)/([^/]+)/*$"
    host = F.concat(F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2))
    label = F.concat_ws("/", F.regexp_extract(raw, pattern, 3), F.regexp_extract(raw, pattern, 4))
    provider = F.when(host == "github.com", "github").when(host == "gitlab.com", "gitlab").otherwise("")
    known = provider != ""
    return F.struct(F.when(known, label).otherwise(short_home(c)).alias("label"), F.when(known, F.concat(F.lit("https://"), host, F.lit("/"), label)).otherwise("").alias("url"), provider.alias("provider"))


def _title(word: Column) -> Column:
    return F.when(F.lower(word) == "gpt", "GPT").when(word.rlike("^[0-9]"), word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word)))))


def title_words(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, "[- ]"), lambda w: w != ""), _title), " ")


def display_model(c: Column) -> Column:
    s = _trim(c)
    rest = F.split(F.regexp_replace(F.regexp_replace(s, "(?i)^claude-", ""), r"-\d{8}$", ""), "-")
    tiers = F.array(F.lit("opus"), F.lit("sonnet"), F.lit("haiku"))
    tier = F.get(F.filter(rest, lambda w: F.array_contains(tiers, F.lower(w))), F.lit(0))
    version = F.array_join(F.filter(rest, lambda w: ~F.array_contains(tiers, F.lower(w))), ".")
    claude = F.when(tier.isNull(), title_words(F.regexp_replace(s, "(?i)^claude-", ""))).otherwise(F.concat(_title(tier), F.when(version == "", "").otherwise(F.concat(F.lit(" "), version))))
    gpt = F.concat(F.lit("GPT-"), F.regexp_extract(s, "(?i)^gpt-([^-]*)", 1))
    tail = title_words(F.regexp_extract(s, "(?i)^gpt-[^-]*-(.+)$", 1))
    gpt = F.when(tail == "", gpt).otherwise(F.concat(gpt, F.lit(" "), tail))
    named = F.when(s.rlike("(?i)^claude-"), claude).when(s.rlike("(?i)^gpt-"), gpt).when(s.rlike("(?i)^gemini-"), F.concat(F.lit("Gemini "), title_words(F.regexp_replace(s, "(?i)^gemini-", "")))).otherwise(title_words(s))
    return F.when(F.coalesce(s, F.lit("")).isin("", "(none)"), "(none)").otherwise(named)


# -- numbers and times -------------------------------------------------------------------------


def compact_tokens(n: Column) -> Column:
    """1.2k, 3.4m, 5b: one decimal that is not 0; what rounds up to 1000 takes the next unit."""
    a = F.abs(n).cast("double")
    unit = lambda div, suffix: F.concat(F.regexp_replace(F.format_string("%.1f", F.round(a / div, 1)), r"\.0$", ""), F.lit(suffix))
    text = F.when(a < 1000, F.abs(n).cast("string")).when(F.round(a / 1e3, 1) < 1000, unit(1e3, "k")).when(F.round(a / 1e6, 1) < 1000, unit(1e6, "m")).otherwise(unit(1e9, "b"))
    return F.concat(F.when(n < 0, "-").otherwise(""), text)


def usd(nano: Column) -> Column:
    cents = F.round(F.abs(nano) / F.lit(1e7)).cast("long")
    return F.concat(F.when(nano < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.floor(cents / 100), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def human_duration(s: Column) -> Column:
    """18m, 4m 30s, 1h 30m, 4d 2h; — for nothing."""
    i = lambda c: F.floor(c).cast("string")
    m, sec = F.floor(s / 60), F.floor(s % 60)
    minutes = F.when((m < 5) & (sec > 0), F.concat(i(m), F.lit("m "), i(sec), F.lit("s"))).otherwise(F.concat(i(m), F.lit("m")))
    two = lambda a, x, b, y: F.when(F.floor(b) == 0, F.concat(i(a), F.lit(x))).otherwise(F.concat(i(a), F.lit(x + " "), i(b), F.lit(y)))
    return F.when(s <= 0, "—").when(s < 60, F.concat(F.round(s).cast("long").cast("string"), F.lit("s"))).when(s < 3600, minutes).when(s < 86400, two(s / 3600, "h", (s % 3600) / 60, "m")).otherwise(two(s / 86400, "d", (s % 86400) / 3600, "h"))


def day_header(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n == 0, "Today").when(n == 1, "Yesterday").when((n > 1) & (n < 7), F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


#: Names of agents as they are shown, and short ones.
AGENT_NAMES = {"claude-code": "Claude Code", "codex": "Codex", "cursor": "Cursor", "gemini": "Gemini", "antigravity": "Antigravity", "hermes": "Hermes", "grok-build": "Grok Build"}
AGENT_SHORT = {"claude-code": "claude", "grok-build": "grok"}


def _named(c: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), other)


def display_agent(c: Column) -> Column:
    """A known agent's name; of others the words in capitals."""
    return _named(c, AGENT_NAMES, F.initcap(F.translate(c, "-_", "  ")))


def agent_short(c: Column) -> Column:
    return _named(c, AGENT_SHORT, c)


def is_binary(body: Column, sniff: int = 4096) -> Column:
    """Whether bytes are no text: a database's first bytes, a zero byte or bad UTF-8 in the first 4096. A character cut off at their end is none's fault."""
    head = F.substring(body, 1, sniff)
    whole = lambda n: F.is_valid_utf8(F.substring(head, 1, F.greatest(F.octet_length(head) - n, F.lit(0))).cast("string"))
    cut = F.lit(False)  # a character's first bytes at the end: one, two or three of them
    for n, ends in enumerate(("(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])$", "(?:E[0-9A-F]|F[0-4])[89AB][0-9A-F]$", "F[0-4](?:[89AB][0-9A-F]){2}$"), 1):
        cut = cut | (F.hex(head).rlike(ends) & whole(n))
    ok = whole(0) | cut
    return F.coalesce((F.octet_length(body) > 0) & (F.startswith(F.hex(head), F.lit(b"SQLite format 3\0".hex().upper())) | F.hex(head).rlike("^(?:..)*00") | ~ok), F.lit(False))
