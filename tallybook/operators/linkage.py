"""Record linkage of messages to clients and accounts: candidate relations, tiers, unique tails, best scores.

Tiers join on derived keys (all digits, last four, first four), so they are hash joins. A tier that asks for a
unique match counts the accounts that share the token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.scalars import alias_key, digits, squeezed
from tallybook.operators.relational import one_per_key
from tallybook.session import written


def email_owners(rows: DataFrame, id_: str, primary: str, extras: str) -> DataFrame:
    """email, id: one owner for each address (primary and extra ones); the highest id wins."""
    every = F.array_distinct(F.filter(F.concat(F.array(primary), F.coalesce(extras, F.array().cast("array<string>"))), lambda e: e.isNotNull() & (F.trim(e) != "")))
    each = rows.select(F.explode(F.transform(every, lambda e: F.lower(F.trim(e)))).alias("email"), F.col(id_))
    return each.groupBy("email").agg(F.max(id_).alias(id_))


def candidate_clients(sources: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """email, client_id of all sources (table, email column, client column), without repeats."""
    parts = [df.select(F.lower(F.trim(e)).alias("email"), F.col(c).alias("client_id")).where("email <> '' and client_id is not null") for df, e, c in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def tiered_accounts(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """message_id, account_id and tier of each message's best account.

    messages: message_id, client_id, tokens (struct fields full, tails, heads: text arrays), words (upper-case text);
    accounts: account_id, client_id, account_no, bank_word. Tier 1: a full number is the account's; 2: a
    tail that one account of the client has; 3: a tail that several have, whose bank is named; 4: the
    leading digits of a file name that one account has; 5: those, with the bank named; 6: the client's only account.
    Ties go to the smallest token and account.
    """
    a = accounts.select("account_id", "client_id", digits(F.col("account_no")).alias("number"), F.upper("bank_word").alias("bank_word")).where("number <> ''")
    keyed = [
        ("full", a.select("*", F.col("number").alias("token"))),
        ("tails", a.select("*", F.right("number", F.lit(4)).alias("token"))),
        ("heads", a.select("*", F.left("number", F.lit(4)).alias("token"))),
    ]
    found = None
    for (kind, side), base in zip(keyed, (1, 2, 4)):
        tokens = messages.select("message_id", "client_id", "words", F.explode(F.array_distinct(F.col(kind))).alias("token"))
        hit = tokens.join(side, ["client_id", "token"])
        sharing = F.count(F.lit(1)).over(Window.partitionBy("message_id", "token"))
        hit = hit.withColumn("_n", sharing).withColumn("_named", F.coalesce(F.contains("words", "bank_word"), F.lit(False)))
        tier = F.lit(1) if kind == "full" else F.when(F.col("_n") == 1, base).when(F.col("_named"), base + 1)
        hit = hit.withColumn("tier", tier).where("tier is not null").select("message_id", "account_id", "tier", "token")
        found = hit if found is None else found.unionByName(hit)
    only = accounts.groupBy("client_id").agg(F.count(F.lit(1)).alias("_n"), F.min("account_id").alias("account_id")).where("_n = 1")
    sole = messages.join(only, "client_id").select("message_id", "account_id", F.lit(6).alias("tier"), F.lit("").alias("token"))
    return one_per_key(found.unionByName(sole), ["message_id"], [F.col("tier"), F.col("token"), F.col("account_id")]).select("message_id", "account_id", "tier")


def scored_accounts(tokens: DataFrame, accounts: DataFrame) -> DataFrame:
    """message_id, account_id, score of the best account: full number 3, last four 2, last two 1; ties to the smaller id.

    tokens: message_id, token (digits). Only the smallest account of each token and score can win, so accounts are reduced to
    one row for each before the join: a message meets three rows at most for each token, however many accounts share its last digits.
    """
    number = digits(F.col("account_no"))
    keys = F.array(F.struct(number.alias("token"), F.lit(3).alias("score")), F.struct(F.right(number, F.lit(4)).alias("token"), F.lit(2).alias("score")), F.struct(F.right(number, F.lit(2)).alias("token"), F.lit(1).alias("score")))
    sides = accounts.select("account_id", F.explode(keys).alias("k")).groupBy("k.token", "k.score").agg(F.min("account_id").alias("account_id"))
    hits = tokens.join(sides, "token")
    best = hits.groupBy("message_id").agg(F.max_by(F.struct("account_id", "score"), F.struct("score", -F.col("account_id"))).alias("b"))
    return best.select("message_id", "b.account_id", "b.score")


def scored_owned_accounts(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """message_id, account_id, score of the best account among those of the message's client, with tie-breakers.

    messages: message_id, client_id, tokens (digits), recipients and receivers (text arrays); accounts: account_id, client_id,
    account_no, mail_id, bank. Score as above; ties go to an account whose mail id is a recipient of an attachment, then a
    receiver, then to the greater bank name, number and account. An account without any matching token is no match.

    Tokens meet accounts by client and key. Of the accounts that share client, key, score and mail id only the greatest can win, so the others are gone before the join,
    a sort-merge join by hint: the planner counts the rows that keys and tokens are made of and would hold all of them in every task.
    """
    number = digits(F.col("account_no"))
    last = lambda n: F.right(number, F.lit(n))
    keys = F.array(F.struct(number.alias("token"), F.lit(3).alias("score")), F.struct(last(4).alias("token"), F.lit(2).alias("score")), F.struct(last(2).alias("token"), F.lit(1).alias("score")))
    # Accounts are dealt before keys are made of them, so that the groups in a task are as many as a shuffle partition's accounts have, not a file's.
    dealt = accounts.repartition("client_id", "account_id")
    sides = dealt.select("client_id", F.lower(F.trim("mail_id")).alias("mail"), F.struct(F.coalesce("bank", F.lit("")).alias("bank"), number.alias("number"), "account_id").alias("_rank"), F.explode(keys).alias("k"))
    sides = sides.groupBy("client_id", "k.token", "k.score", "mail").agg(F.max("_rank").alias("_rank"))
    tokens = messages.select("message_id", "client_id", "recipients", "receivers", F.explode(F.array_distinct("tokens")).alias("token"))
    named = lambda c: F.coalesce(F.array_contains(c, F.col("mail")), F.lit(False))
    hits = tokens.join(sides.hint("merge"), ["client_id", "token"]).select("message_id", "score", named("recipients").alias("_r"), named("receivers").alias("_v"), "_rank")
    best = hits.groupBy("message_id").agg(F.max(F.struct("score", "_r", "_v", "_rank")).alias("b"))
    return best.select("message_id", "b._rank.account_id", "b.score")


#: Characters by which a part of a number is looked up.
PART = 4


def found_account(wanted: DataFrame, accounts: DataFrame) -> DataFrame:
    """key, account_id and tier of the account that a typed number means, among those of its client.

    wanted: key, client_id, typed. 1: equal; 2: but for case; 3: the number contains what was typed; 4: it ends with it; 5: the
    digits are equal. The smallest account of the first tier that has one. A suffix is contained as well, so 4 never comes first.

    Every tier has its key beside the client: the number, its digits, or for parts the first PART characters of what was typed, against all parts of numbers of that length.
    Parts are made of those lengths only that a client's typed numbers begin with. The joins are sort-merge joins by hint, as the planner counts the rows that parts
    are made of, not the parts, and would send them all through the driver.
    """
    w = wanted.select("key", "client_id", F.trim("typed").alias("typed")).where("typed <> ''").withColumn("small", F.lower("typed"))
    a = accounts.select("client_id", "account_id", "account_no", F.lower("account_no").alias("have"))
    whole = w.join(a.withColumnRenamed("have", "small").hint("merge"), ["client_id", "small"]).select("key", "account_id", F.when(F.col("account_no") == F.col("typed"), 1).otherwise(2).alias("tier"))
    lengths = w.groupBy("client_id").agg(F.collect_set(F.least(F.length("small"), F.lit(PART))).alias("_lengths"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("have"), F.lit(1)))
    parts = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform("_lengths", lambda n: F.substring(F.col("have"), i, n)))))
    held = a.join(lengths.hint("merge"), "client_id").select("client_id", "account_id", "have", F.explode(parts).alias("_part"))
    within = w.withColumn("_part", F.substring("small", 1, PART)).join(held.hint("merge"), ["client_id", "_part"]).where(F.contains("have", "small")).select("key", "account_id", F.lit(3).alias("tier"))
    same = w.withColumn("_digits", digits(F.col("typed"))).join(a.withColumn("_digits", digits(F.col("account_no"))).hint("merge"), ["client_id", "_digits"]).select("key", "account_id", F.lit(5).alias("tier"))
    best = whole.unionByName(within).unionByName(same).groupBy("key").agg(F.min(F.struct("tier", "account_id")).alias("b"))
    return best.select("key", "b.account_id", "b.tier")


# Words that name a bank in a message, and the part of the bank's name that each stands for, in order.
BANK_WORDS = {
    "hdfc": "hdfc", "icici": "icici", "sbi": "sbi", "state bank": "sbi", "kotak": "kotak", "axis": "axis", "bank of maharashtra": "maharashtra", "canara": "canara",
    "pnb": "punjab national", "punjab national": "punjab national", "surat national": "surat national", "spcb": "spcb", "sutex": "sutex",
}


def fallback_accounts(messages: DataFrame, accounts: DataFrame) -> DataFrame:
    """message_id, account_id and tier of the account of a message's client when no number in it names one.

    messages: message_id, client_id, recipients, hint (sender and subject) and tails (text array); accounts: account_id,
    client_id, mail_id, bank, account_no. 1: the only account with a recipient's mail id, the first such recipient; 2: the client's
    only account; 3: the only one of the bank that the hint names first; 4: the only one with a tail, the least such tail.
    """
    a = accounts.select("account_id", "client_id", F.lower(F.trim("mail_id")).alias("mail"), F.lower("bank").alias("bank"), digits(F.col("account_no")).alias("number"))
    one = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("account_id").alias("account_id")).where("_n = 1").drop("_n")
    m = messages.select("message_id", "client_id", "hint", "tails", F.transform("recipients", lambda r: F.lower(F.trim(r))).alias("recipients"))
    by_mail = m.select("message_id", "client_id", F.posexplode("recipients").alias("place", "mail")).join(one(a.where("mail <> ''"), "client_id", "mail"), ["client_id", "mail"])
    sole = m.join(one(a, "client_id"), "client_id").select("message_id", "account_id", F.lit(2).alias("tier"), F.lit(0).alias("place"), F.lit("").alias("word"))
    said = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(w).alias("said"), F.lit(p).alias("part")) for i, (w, p) in enumerate(BANK_WORDS.items())))
    named = F.filter(said, lambda s: F.contains(F.lower("hint"), s["said"]))
    # An account is known by the parts that its bank's name has, and only where it is its client's only one with the part.
    parts = F.array(*map(F.lit, dict.fromkeys(BANK_WORDS.values())))
    of_bank = one(a.select("account_id", "client_id", F.explode(F.filter(parts, lambda p: F.contains("bank", p))).alias("part")), "client_id", "part")
    by_bank = m.select("message_id", "client_id", F.explode(named).alias("b")).select("message_id", "client_id", "b.place", "b.part").join(of_bank, ["client_id", "part"])
    by_tail = m.select("message_id", "client_id", F.explode(F.array_distinct("tails")).alias("word")).join(one(a.withColumn("word", F.right("number", F.lit(4))), "client_id", "word"), ["client_id", "word"])
    found = by_mail.select("message_id", "account_id", F.lit(1).alias("tier"), "place", F.lit("").alias("word")).unionByName(sole)
    found = found.unionByName(by_bank.select("message_id", "account_id", F.lit(3).alias("tier"), "place", F.lit("").alias("word")))
    found = found.unionByName(by_tail.select("message_id", "account_id", F.lit(4).alias("tier"), F.lit(0).alias("place"), "word"))
    return one_per_key(found, ["message_id"], [F.col("tier"), F.col("place"), F.col("word")]).select("message_id", "account_id", "tier")


#: Aliases of so many different words are sent to every task; texts meet more of them by shuffles.
FEW = 50_000


def longest_alias(texts: DataFrame, aliases: DataFrame, least: int = 6) -> DataFrame:
    """text_id, owner_id, score: the longest alias whose words occur in the text (score: its length), or that occurs when all
    blanks are squeezed out (length - 1); `least` at least, ties to the smaller owner.

    Aliases are found by their first word or first four squeezed characters, so that each text meets few of them.
    """
    a = aliases.select("owner_id", alias_key(F.col("alias")).alias("words")).where(F.length("words") >= 4).groupBy("words").agg(F.min("owner_id").alias("owner_id"))
    a = written(a.withColumn("tight", squeezed(F.col("words"))), "aliases")
    # Texts are joined by sort-merge, or meet aliases that are known to be few: the planner takes words and pieces of texts to be no more than the texts.
    side = F.broadcast if a.count() <= FEW else lambda df: df.hint("merge")
    t = texts.select("text_id", alias_key(F.col("text")).alias("body"))
    # Keys are looked up without the texts; only texts that meet an alias are fetched for the comparison.
    words = t.select("text_id", F.explode(F.array_distinct(F.split("body", " "))).alias("k"))
    by_word = words.join(side(a.withColumn("k", F.element_at(F.split("words", " "), 1))), "k").select("text_id", "owner_id", "words", "tight")
    tight = squeezed(F.col("body"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(tight) - 3, F.lit(1))), lambda i: F.substring(tight, i, F.lit(4))))
    by_gram = t.select("text_id", F.explode(grams).alias("k")).join(side(a.withColumn("k", F.substring("tight", 1, 4))), "k").select("text_id", "owner_id", "words", "tight")
    met = by_word.unionByName(by_gram).distinct().join(t.hint("merge"), "text_id")
    whole = F.contains(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), "words", F.lit(" ")))
    score = F.when(whole, F.length("words")).when(F.contains(tight, F.col("tight")), F.length("words") - 1)
    every = met.withColumn("score", score).where(F.col("score") >= least).select("text_id", "owner_id", "score")
    return one_per_key(every, ["text_id"], [F.desc("score"), F.col("owner_id")])


def latest_link(entries: DataFrame, mails: DataFrame) -> DataFrame:
    """entry_id and the link of the newest mail with the same normalised message id that has a link; empty ids match nothing."""
    m = mails.where("msg_id is not null and link is not null").groupBy("msg_id").agg(F.max_by("link", F.struct("fetched_at", "mail_id")).alias("link"))
    return entries.join(m, "msg_id", "left").select("entry_id", "link")


def unmapped(accounts: DataFrame, mapped: DataFrame, number: Column, code: Column) -> DataFrame:
    """Accounts whose digits and whose code are both unknown to mapped(number, code): one anti join for each key."""
    out = accounts.withColumn("_number", F.nullif(digits(number), F.lit(""))).withColumn("_code", F.nullif(F.trim(code), F.lit("")))
    out = out.join(mapped.select(F.nullif(digits(F.col("number")), F.lit("")).alias("_number")).distinct(), "_number", "left_anti")
    return out.join(mapped.select(F.nullif(F.trim("code"), F.lit("")).alias("_code")).distinct(), "_code", "left_anti").drop("_number", "_code")
