"""What tool calls did to a repository, from their commands and their output: verbs, push classes, confirmed SHAs, anchors,
amend lineage and the turns that belong to a branch.

All of it but the cutting of command lines is column expressions and windows. A command's input is never proof of a commit:
SHAs come from output lines of the form in which git itself confirms a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.functions.shell import invocations
from tallyflow.operators.branch import resolve_shas

# git's own options and sub-commands, as far as they matter here.
GLOBAL_WITH_VALUE = ("-C", "-c", "--git-dir", "--work-tree", "--namespace", "--exec-path")
RETARGETING = ("-C", "--git-dir", "--work-tree", "--namespace", "--exec-path")
PUSH_WITH_VALUE = ("--receive-pack", "--exec", "--push-option", "--recurse-submodules", "-o")
PUSH_PLAIN = (
    "--all", "--atomic", "--delete", "--dry-run", "--follow-tags", "--force", "--force-if-includes", "--force-with-lease", "--ipv4", "--ipv6", "--mirror", "--no-atomic", "--no-force-if-includes",
    "--no-signed", "--no-thin", "--no-verify", "--porcelain", "--progress", "--prune", "--quiet", "--set-upstream", "--tags", "--thin", "--verbose",
)
#: Refs that hold receipts; a push of one is no push of a branch.
RECEIPT_REFS = ("refs/aireceipts/", "refs/receipts/")
COMMIT_LINE = r"^\[[^\]\n]* ([0-9a-f]{7,40})\]"
PUSH_LINE = r"(?:^|\s)(?:[0-9a-f]{7,40})\.\.\.?([0-9a-f]{7,40})\s+\S+ -> \S+"
PUSH_SHA_LINE = r"(?:^|\s)([0-9a-f]{7,40}) -> \S+"
FULL = "entire session (slice unavailable)"

_WITH_VALUE = r"^--(git-dir|work-tree|namespace|exec-path)="


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def base_name(word: str) -> str:
    """SQL: the last part of a path."""
    return f"regexp_extract({word}, '([^/]*)/*$', 1)"


def git_call(argv: str) -> str:
    """SQL: (sub, args, retargeted) of an argument list that runs git, else null: the sub-command after assignments and global
    options, what follows it, and whether an option points git at another repository or folder.

    One fold over the words after ``git``: an option that takes a value takes the next word along; the first other word is the
    sub-command, all later ones are its arguments.
    """
    program = f"coalesce(array_position(transform({argv}, w -> not w rlike '^[A-Za-z_][A-Za-z0-9_]*='), true), 0)"
    words = f"slice({argv}, cast({program} as int) + 1, size({argv}))"
    start = "named_struct('sub', cast(null as string), 'args', cast(array() as array<string>), 'value', false, 'retargeted', false)"
    step = f"""case
      when s.sub is not null then named_struct('sub', s.sub, 'args', array_append(s.args, w), 'value', false, 'retargeted', s.retargeted)
      when s.value or w like '-%' then named_struct('sub', cast(null as string), 'args', s.args, 'value', not s.value and w in ({_quoted(GLOBAL_WITH_VALUE)}), 'retargeted', s.retargeted or w in ({_quoted(RETARGETING)}) or w rlike '{_WITH_VALUE}')
      else named_struct('sub', w, 'args', s.args, 'value', false, 'retargeted', s.retargeted) end"""
    name = base_name(f"element_at({argv}, cast({program} as int))")
    return f"case when {program} > 0 and {name} = 'git' then aggregate({words}, {start}, (s, w) -> {step}, s -> named_struct('sub', s.sub, 'args', s.args, 'retargeted', s.retargeted)) end"


def push_args(args: str) -> Column:
    """What the arguments of a push ask for: (options, words, remote, ambiguous).

    One fold: ``want`` says what the next word is to the option before it; after ``--`` all words are plain.
    """
    start = "named_struct('want', '', 'plain', false, 'options', cast(array() as array<string>), 'words', cast(array() as array<string>), 'remote', cast(null as string), 'ambiguous', false)"

    def to(want: str = "''", plain: str = "s.plain", options: str = "s.options", words: str = "s.words", remote: str = "s.remote", ambiguous: str = "s.ambiguous") -> str:
        return f"named_struct('want', {want}, 'plain', {plain}, 'options', {options}, 'words', {words}, 'remote', {remote}, 'ambiguous', {ambiguous})"

    flags = "regexp_extract(w, '^-([nduqvf46]*)', 1)"
    rest = f"substring(w, length({flags}) + 2)"
    short = f"filter(array(if({flags} like '%n%', '--dry-run', null), if({flags} like '%d%', '--delete', null)), x -> x is not null)"
    step = f"""case
      when s.want = 'value' then {to()}
      when s.want = 'repo' then {to(remote="w", ambiguous="s.ambiguous or w = ''")}
      when s.plain then {to(words="array_append(s.words, w)")}
      when w = '--' then {to(plain="true")}
      when w = '--repo' then {to(want="'repo'")}
      when w like '--repo=%' then {to(remote="substring(w, 8)", ambiguous="s.ambiguous or w = '--repo='")}
      when w in ({_quoted(PUSH_WITH_VALUE)}) then {to(want="'value'")}
      when w rlike '^--(receive-pack|exec|push-option|recurse-submodules|signed|force-with-lease)=' then {to()}
      when w like '--%' then {to(options="array_append(s.options, w)", ambiguous=f"s.ambiguous or w not in ({_quoted(PUSH_PLAIN)})")}
      when w like '-%' and w <> '-' then {to(want=f"if({rest} = 'o', 'value', '')", options=f"concat(s.options, {short})", ambiguous=f"s.ambiguous or not ({rest} = '' or {rest} like 'o%')")}
      else {to(words="array_append(s.words, w)")} end"""
    done = "named_struct('options', s.options, 'remote', if(s.remote is null, get(s.words, 0), s.remote), 'refspecs', if(s.remote is null, slice(s.words, 2, size(s.words)), s.words), 'ambiguous', s.ambiguous or s.want <> '')"
    return F.expr(f"aggregate({args}, {start}, (s, w) -> {step}, s -> {done})")


def push_class(git: str, push: str) -> Column:
    """Why a command isn't a plain push of the current branch to origin; null if it is one. The first reason that holds.

    ``git`` and ``push`` name columns of ``git_call`` and ``push_args``.
    """
    spec = f"regexp_replace(get({push}.refspecs, 0), '^[+]', '')"
    target = f"if(instr({spec}, ':') > 0, substring({spec}, instr({spec}, ':') + 1), {spec})"
    receipt = lambda x: " or ".join(f"startswith({x}, '{r}')" for r in RECEIPT_REFS)
    branch = f"""case when {spec} = 'HEAD' then true when {spec} like ':%' then false
      when instr({spec}, ':') > 0 then {spec} rlike '^HEAD:refs/heads/(?s:.+)'
      when {spec} like 'refs/heads/%' then length({spec}) > 11
      else {spec} <> '' and {spec} not like '-%' and instr({spec}, '*') = 0 and {spec} <> 'tag' and {spec} not like 'refs/tags/%' and not {spec} rlike '^[0-9a-fA-F]{{7,40}}$' end"""
    has = lambda option: f"array_contains({push}.options, '{option}')"
    rules = [
        (f"{git} is null", "not-git"), (f"{git}.sub is distinct from 'push'", "not-push"), (f"{git}.retargeted", "retargeted"), (f"{push}.ambiguous", "ambiguous"), (has("--dry-run"), "dry-run"),
        (has("--delete"), "delete"), (has("--mirror"), "mirror"), (has("--all"), "all"), (f"{push}.remote <> 'origin'", "non-origin"), (f"size({push}.refspecs) = 0 and {has('--tags')}", "tags-only"),
        (f"size({push}.refspecs) = 0 and {has('--prune')}", "prune-only"), (f"size({push}.refspecs) > 1", "ambiguous-refspecs"), (f"size({push}.refspecs) = 1 and ({receipt(target)})", "receipts-ref"),
        (f"size({push}.refspecs) = 1 and not ({branch})", "not-branch-refspec"),
    ]
    return F.expr("case " + " ".join(f"when {rule} then '{reason}'" for rule, reason in rules) + " end")


def moves_head(git: str) -> Column:
    """Whether a git command can put HEAD elsewhere, so that the next amend's pre-image can't be told."""
    args, sub = f"{git}.args", f"{git}.sub"
    words = f"filter({args}, a -> a not like '-%')"
    has = lambda *options: " or ".join(f"array_contains({args}, '{o}')" for o in options)
    paths = f"(array_position({args}, '--') between 1 and size({args}) - 1 or {has('-p', '--patch')})"
    side = f"least(if(array_position({args}, '--ours') = 0, 9999999, array_position({args}, '--ours')), if(array_position({args}, '--theirs') = 0, 9999999, array_position({args}, '--theirs')))"
    files_of_side = f"exists(slice({args}, cast({side} as int) + 1, size({args})), a -> a not like '-%')"
    head = f"(get({words}, 0) = 'HEAD' or get({words}, 0) like 'refs/heads/%')"
    rules = {
        "switch": "true", "pull": "true", "filter-branch": "true", "checkout": f"not ({paths} or {files_of_side})",
        "reset": f"not ({paths} or exists({args}, a -> a = '--pathspec-from-file' or a like '--pathspec-from-file=%') or (not ({has('--soft', '--hard', '--merge', '--keep')}) and size({words}) > 1))",
        "rebase": f"not ({has('--show-current-patch')})", "am": f"not ({has('--show-current-patch')})", "cherry-pick": f"not ({has('-n', '--no-commit')})", "revert": f"not ({has('-n', '--no-commit')})",
        "merge": f"not ({has('--squash')})", "bisect": f"get({words}, 0) not in ('help', 'log', 'terms', 'view', 'visualize')", "stash": f"get({words}, 0) = 'branch'",
        "update-ref": f"{has('--stdin')} or ({head} and ({has('-d')} or size({words}) > 1))", "symbolic-ref": f"get({words}, 0) = 'HEAD' and ({has('--delete')} or size({words}) > 1)", "fetch": f"{has('--update-head-ok')}",
    }
    return F.expr(f"coalesce(case {sub} " + " ".join(f"when '{s}' then {rule}" for s, rule in rules.items()) + " end, false)")


def confirmed(verb: str, output: str) -> Column:
    """The SHAs that git's own lines in an output confirm for commits or for pushes, in order; other lines give none.

    Of a push's ``old..new`` the new one counts.
    """
    lines = f"split(coalesce({output}, ''), '\\n')"
    found = lambda line, pattern: f"regexp_extract({line}, r'{pattern}', 1)"
    trimmed = r"regexp_replace(l, r'^\s+|\s+$', '')"
    one = found(trimmed, COMMIT_LINE) if verb == "commit" else f"coalesce(nullif({found('l', PUSH_LINE)}, ''), {found('l', PUSH_SHA_LINE)})"
    return F.expr(f"filter(transform({lines}, l -> {one}), x -> x <> '')")


def told(calls: DataFrame) -> DataFrame:
    """(session_id, turn_index, call_ord, commit_runs, push_runs, gits): the shell calls that run git, with their commands as ``git_call``
    cuts them and all SHAs that lines of either verb confirm.

    What reads calls below takes this table too, so a caller with several uses for it can store it and cut no command line twice.
    """
    if "gits" in calls.columns:
        return calls
    shell = calls.where("is_shell").select("session_id", "turn_index", "call_ord", confirmed("commit", "output").alias("commit_runs"), confirmed("push", "output").alias("push_runs"), invocations(F.col("input_json")).alias("argvs"))
    return shell.withColumn("gits", F.expr(f"transform(argvs, argv -> {git_call('argv')})")).drop("argvs").where("exists(gits, g -> g is not null)")


def git_commands(calls: DataFrame) -> DataFrame:
    """(session_id, turn_index, call_ord, inv_ord, git, amend, barrier, runs): the git commands of shell calls, one row each.

    ``calls``: (session_id, turn_index, call_ord, is_shell, input_json, output). ``runs`` are the SHAs that the output confirms
    for this command: as many commits as commit lines pair one to one, a lone push takes all push lines, anything else is
    ambiguous and takes none. Nothing is shuffled.
    """
    gits = told(calls)
    at = lambda sub: F.expr(f"filter(transform(gits, (g, i) -> if(g.sub = '{sub}', i, null)), i -> i is not null)")
    each = gits.withColumn("commits", at("commit")).withColumn("pushes", at("push")).select("*", F.posexplode("gits").alias("inv_ord", "git")).where("git is not null")
    runs = F.expr("""case when git.sub = 'commit' and size(commits) = size(commit_runs) then array(get(commit_runs, cast(array_position(commits, inv_ord) - 1 as int)))
      when git.sub = 'push' and size(pushes) = 1 then push_runs else cast(array() as array<string>) end""")
    return each.select("session_id", "turn_index", "call_ord", "inv_ord", "git", F.array_contains("git.args", "--amend").alias("amend"), moves_head("git").alias("barrier"), runs.alias("runs"))


def owned(commands: DataFrame, commits: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``verb``, ``shas`` (the branch's commits that the runs stand for) and ``own`` to commits and pushes among
    ``git_commands``; other commands stay with nulls.

    A run stands for the one branch commit that begins with it, for none if several do, else for what ``aliases``
    (session_id, run, sha) recovered in its session.
    """
    key = ["session_id", "turn_index", "call_ord", "inv_ord"]
    runs = commands.where("git.sub in ('commit', 'push') and size(runs) > 0").select(*key, F.posexplode("runs").alias("place", "run"))
    named = resolve_shas(runs, commits)
    if aliases is not None:
        known = aliases.join(commits.select("sha"), "sha", "left_semi").select("session_id", "run", F.col("sha").alias("recovered"))
        named = named.join(known, ["session_id", "run"], "left").withColumn("sha", F.when(F.col("n_matches") > 0, F.col("sha")).otherwise(F.col("recovered")))
    found = named.where("sha is not null").groupBy(*key).agg(F.expr("transform(array_sort(collect_list(struct(place, sha))), x -> x.sha)").alias("shas"))
    joined = commands.join(found, key, "left")
    writes = F.col("git.sub").isin("commit", "push")
    return joined.withColumn("verb", F.when(writes, F.col("git.sub"))).withColumn("own", F.when(writes, F.col("shas").isNotNull()))


def anchors(commands: DataFrame) -> DataFrame:
    """(session_id, turn_index, call_ord, inv_ord, verb, amend, runs, shas, own, chain): the confirmed writes of ``owned``, with
    amend lineage.

    An amend's pre-image is the commit command before it, if that was confirmed and nothing between them moved HEAD. Pre-images
    are always the commit command before, so chains are runs of rows: ``chain`` numbers them, and a commit is own if it
    or a later one of its chain is.
    """
    order = W.partitionBy("session_id").orderBy("turn_index", "call_ord", "inv_ord")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    moved = F.count_if("barrier").over(upto)
    rows = commands.withColumn("moved", moved).where("verb is not null").withColumn("is_commit", F.col("verb") == "commit")
    per_verb = W.partitionBy("session_id", "verb").orderBy("turn_index", "call_ord", "inv_ord")
    linked = F.col("amend") & F.coalesce((F.lag(F.size("runs")).over(per_verb) > 0) & (F.lag("moved").over(per_verb) == F.col("moved")), F.lit(False))
    rows = rows.withColumn("chain", F.count_if(~linked).over(per_verb.rowsBetween(W.unboundedPreceding, W.currentRow)))
    later = W.partitionBy("session_id", "verb", "chain").orderBy("turn_index", "call_ord", "inv_ord").rowsBetween(W.currentRow, W.unboundedFollowing)
    own = F.when(F.col("is_commit"), F.max("own").over(later)).otherwise(F.col("own"))
    found = rows.withColumn("own", own).where("size(runs) > 0")
    return found.select("session_id", "turn_index", "call_ord", "inv_ord", "verb", F.when(F.col("is_commit"), F.col("amend")).otherwise(False).alias("amend"), "runs", "shas", "own", F.when(F.col("is_commit"), F.col("chain")).alias("chain"))


def amend_chains(found: DataFrame) -> DataFrame:
    """(session_id, chain, n_commits, first_turn, last_turn, run, own): each chain of amends as its last commit."""
    last = F.struct("turn_index", "call_ord", "inv_ord")
    return found.where("verb = 'commit'").groupBy("session_id", "chain").agg(
        F.count("*").alias("n_commits"), F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.max_by(F.get("runs", F.lit(0)), last).alias("run"), F.max("own").alias("own")
    )


def scopes(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, kind, start_turn, end_turn, turn_count, label): the turns of each session that belong to the branch.

    From after the last foreign write before the first own one to the last own one; a foreign write in the first own one's turn
    starts the scope at that turn. Without an own commit, pushes alone included, the whole session, with a label.
    ``sessions``: (session_id, turn_count).
    """
    at = F.struct("turn_index", "call_ord", "inv_ord")
    own = found.where("own").groupBy("session_id").agg(F.min(at).alias("first"), F.max("turn_index").alias("end_turn"), F.max((F.col("verb") == "commit").cast("int")).alias("commits")).where("commits = 1")
    foreign = found.where("not own").join(own.select("session_id", "first"), "session_id").where(at < F.col("first")).groupBy("session_id").agg(F.max("turn_index").alias("foreign"))
    rows = sessions.join(own, "session_id", "left").join(foreign, "session_id", "left")
    part = F.col("first").isNotNull()
    start = F.when(F.col("foreign").isNull(), 0).otherwise(F.least(F.col("foreign") + 1, F.col("first.turn_index")))
    last = F.greatest(F.lit(0), F.col("turn_count") - 1)
    return rows.select("session_id", F.when(part, "slice").otherwise("full").alias("kind"), F.when(part, start).otherwise(0).cast("long").alias("start_turn"), F.when(part, F.col("end_turn")).otherwise(last).cast("long").alias("end_turn"), "turn_count", F.when(~part, FULL).alias("label"))


def anchor_summary(commands: DataFrame) -> DataFrame:
    """(session_id, has_own, write_count): whether a write of the session made a commit of the branch, and how many calls wrote,
    whatever their output."""
    writes = commands.where("verb is not null")
    return writes.groupBy("session_id").agg(F.max("own").alias("has_own"), F.count_distinct("turn_index", "call_ord").alias("write_count"))


def anchor_events(commands: DataFrame) -> DataFrame:
    """(session_id, turn_index, place, sha): the branch's commits that each turn's commit commands made, each once, in order."""
    made = commands.where("verb = 'commit' and own").select("session_id", "turn_index", "call_ord", "inv_ord", F.posexplode("shas").alias("at", "sha"))
    first = made.groupBy("session_id", "turn_index", "sha").agg(F.min(F.struct("call_ord", "inv_ord", "at")).alias("first"))
    return first.select("session_id", "turn_index", (F.row_number().over(W.partitionBy("session_id", "turn_index").orderBy("first")) - 1).cast("int").alias("place"), "sha")


def call_writes(calls: DataFrame) -> DataFrame:
    """(session_id, turn_index, call_ord, verb, runs): shell calls that commit or push, by their first such command, with all SHAs that
    lines of that verb confirm in the output, whichever command they are of."""
    verb = F.expr("get(filter(transform(gits, g -> g.sub), v -> v in ('commit', 'push')), 0)")
    return told(calls).withColumn("verb", verb).where("verb is not null").select("session_id", "turn_index", "call_ord", "verb", F.expr("if(verb = 'commit', commit_runs, push_runs)").alias("runs"))


def commit_subjects(calls: DataFrame) -> DataFrame:
    """(session_id, subject): the distinct first ``-m`` texts of the commit commands of shell calls, empty ones left out.

    Later ones are paragraphs; what another option takes, or stands after ``--``, is no text.
    """
    start = "named_struct('want', '', 'subject', cast(null as string))"
    to = lambda want="''", subject="s.subject": f"named_struct('want', {want}, 'subject', {subject})"
    step = f"""case when s.subject is not null or s.want = 'done' then s when s.want = 'value' then {to()} when s.want = 'subject' then {to(subject="w")}
      when w = '--' then {to(want="'done'")} when w in ('--message', '-m', '-am') then {to(want="'subject'")} when w like '--message=%' then {to(subject="substring(w, 11)")}
      when w like '-m_%' then {to(subject="substring(w, 3)")} when w in ('-c', '-C', '-F', '-t', '-S') then {to(want="'value'")} else s end"""
    found = told(calls).select("session_id", F.explode("gits").alias("git")).where("git.sub = 'commit'").select("session_id", F.expr(f"aggregate(git.args, {start}, (s, w) -> {step}, s -> s.subject)").alias("subject"))
    return found.where("subject <> ''").distinct()
