"""The office's flows, put together from the other operators: mail to entries, coverage rows, pending ledger accounts, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.fiscal import fy_of, month_dimension
from tallybook.functions.scalars import account_numbers, digits, first_filled, is_cash, masked_tails, message_id, with_period
from tallybook.operators.intervals import month_gaps
from tallybook.operators.ledger import reconcile, voucher_serial
from tallybook.operators.linkage import fallback_accounts
from tallybook.operators.relational import one_per_key


def mail_entries(mails: DataFrame, emails: DataFrame, accounts: DataFrame) -> DataFrame:
    """An entry for each mail whose recipient belongs to a client: mail_id, msg_id, fy, client_id, account_id, start, end.

    mails: mail_id, msg_id, received (date), recipients (array), subject, attached (text); emails: email, client_id; accounts:
    account_id, client_id, account_no, bank_word, mail_id, bank. The first recipient that any client has decides. Of its clients one
    whose account number or masked tail is in the mail is preferred, then the smallest; without such a number the fallback picks the
    account. A mail without a message id gets one from its own id. The period is the one in the subject, else the month before.
    """
    text = F.concat_ws(" ", "subject", "attached")
    owned = emails.select("email", "client_id").distinct()
    # Mails never meet all clients of an address: an address has its smallest client, and for each number or tail the one that would win.
    known = owned.groupBy("email").agg(F.min("client_id").alias("_least"))
    told = mails.select("mail_id", account_numbers(text).alias("full"), masked_tails(text).alias("tails"), F.upper(text).alias("words"), "recipients", text.alias("hint"))
    each = told.select("mail_id", F.posexplode("recipients").alias("place", "email")).withColumn("email", F.lower(F.trim("email")))
    first = each.join(known, "email").groupBy("mail_id").agg(F.min(F.struct("place", "email", "_least")).alias("_f")).select("mail_id", "_f.email", "_f._least")
    m = told.join(first.hint("merge"), "mail_id")
    tokens = m.select("mail_id", "email", "words", F.explode(F.array_distinct(F.concat(F.transform("full", lambda t: F.struct(F.lit("full").alias("kind"), t.alias("token"))), F.transform("tails", lambda t: F.struct(F.lit("tail").alias("kind"), t.alias("token")))))).alias("_t"))
    tokens = tokens.select("mail_id", "email", "words", "_t.kind", "_t.token")
    hits = tokens.join(_winners(owned, accounts).hint("merge"), ["email", "kind", "token"]).where("bank_word is null or contains(words, bank_word)")
    # The smallest client that any token finds is the smallest of that token too, so nothing that could win is missing among the winners.
    hit = hits.groupBy("mail_id").agg(F.min(F.struct("client_id", "tier", "token", "account_id")).alias("_h")).select("mail_id", F.col("_h.client_id").alias("_client"), F.col("_h.account_id").alias("_hit"))
    chosen = m.join(hit.hint("merge"), "mail_id", "left").withColumn("client_id", F.coalesce("_client", "_least"))
    lost = chosen.where("_hit is null").select(F.col("mail_id").alias("message_id"), "client_id", "recipients", "hint", "tails")
    rest = fallback_accounts(lost, accounts).select(F.col("message_id").alias("mail_id"), F.col("account_id").alias("_rest"))
    chosen = chosen.select("mail_id", "client_id", "_hit")
    out = with_period(mails, "subject", "received").join(chosen, "mail_id").join(rest, "mail_id", "left")
    own = F.coalesce(message_id(F.col("msg_id")), F.concat(F.lit("maillog-"), F.col("mail_id").cast("string")))
    return out.select("mail_id", own.alias("msg_id"), fy_of(F.col("received")).alias("fy"), "client_id", F.coalesce("_hit", "_rest").alias("account_id"), "start", "end", "received")


def _winners(owned: DataFrame, accounts: DataFrame) -> DataFrame:
    """email, kind, token, bank_word, client_id, tier, account_id: of the clients of an address the smallest whose account the token is, with that account.

    Tiers are those of tiered_accounts. bank_word is set where several accounts of the client have the tail, so that the mail has to name the bank.
    """
    a = accounts.select("client_id", "account_id", digits(F.col("account_no")).alias("number"), F.upper("bank_word").alias("bank_word")).where("number <> ''")
    full = a.select("client_id", F.lit("full").alias("kind"), F.col("number").alias("token"), F.lit(1).alias("tier"), F.lit(None).cast("string").alias("bank_word"), "account_id")
    tail = F.right("number", F.lit(4))
    once = a.groupBy("client_id", tail.alias("token")).agg(F.count(F.lit(1)).alias("_n"), F.min("account_id").alias("account_id"))
    sole = once.where("_n = 1").select("client_id", F.lit("tail").alias("kind"), "token", F.lit(2).alias("tier"), F.lit(None).cast("string").alias("bank_word"), "account_id")
    several = a.where("bank_word is not null").withColumn("token", tail).join(once.where("_n > 1").select("client_id", "token"), ["client_id", "token"], "left_semi")
    several = several.select("client_id", F.lit("tail").alias("kind"), "token", F.lit(3).alias("tier"), "bank_word", "account_id")
    every = full.unionByName(sole).unionByName(several)
    best = owned.hint("merge").join(every, "client_id").groupBy("email", "kind", "token", "bank_word").agg(F.min(F.struct("client_id", "tier", "account_id")).alias("_b"))
    return best.select("email", "kind", "token", "bank_word", "_b.*")


def new_entries(found: DataFrame, have: DataFrame) -> DataFrame:
    """Of the entries those whose message id their fiscal year does not have yet, the earliest of each: a second run adds nothing."""
    fresh = one_per_key(found, ["fy", "msg_id"], [F.col("received"), F.col("mail_id")])
    return fresh.join(have.select("fy", "msg_id"), ["fy", "msg_id"], "left_anti")


def coverage_rows(entries: DataFrame, universe: DataFrame, keys: list[str], low: Column, high: Column, month_round: bool = False) -> DataFrame:
    """kind, start, end for each key: `received` entries that touch the window, `partial` gaps and `block`s of missing months.

    A partial gap is one in a month that an entry begins in; with month_round there are none. The other months that lack days
    are blocks; a fully covered month ends a block, one with partial gaps neither ends nor joins it. Equal rows are one.
    """
    here = entries.where((F.col("from_date") <= high) & (F.col("last_date") >= low))
    received = here.select(*keys, F.lit("received").alias("kind"), F.col("from_date").alias("start"), F.col("last_date").alias("end"))
    gaps = month_gaps(entries, universe, keys, low, high)
    begun = here.select(*keys, F.trunc("from_date", "MM").cast("date").alias("month_start")).distinct()
    partial = gaps.join(begun, [*keys, "month_start"], "left_semi") if not month_round else gaps.limit(0)
    grid = month_dimension(universe.select(*keys).distinct(), low, high).select(*keys, "month_start", "month_end")
    lacking = gaps.select(*keys, "month_start").distinct().withColumn("_lacks", F.lit(True))
    aside = partial.select(*keys, "month_start").distinct().withColumn("_aside", F.lit(True))
    months = grid.join(lacking, [*keys, "month_start"], "left").join(aside, [*keys, "month_start"], "left")
    covered = F.count(F.when(F.col("_lacks").isNull(), 1)).over(Window.partitionBy(*keys).orderBy("month_start"))
    runs = months.withColumn("_run", covered).where("_lacks and _aside is null")
    blocks = runs.groupBy(*keys, "_run").agg(F.min("month_start").alias("start"), F.max("month_end").alias("end"))
    out = received.unionByName(partial.select(*keys, F.lit("partial").alias("kind"), F.col("gap_start").alias("start"), F.col("gap_end").alias("end")))
    return out.unionByName(blocks.select(*keys, F.lit("block").alias("kind"), "start", "end")).distinct()


def pending_ledger_accounts(ledger: DataFrame, accounts: DataFrame, hidden: list[str], mapped: list[str]) -> DataFrame:
    """Ledger accounts that no account of the client stands for yet, each number once, from the first file that has it.

    ledger: client_id, file, code, number, name; accounts: client_id, account_no, code, account_group. Left out are numbers of accounts in
    the hidden and mapped groups, and codes that any account of the client has; a ledger row without digits is no account.
    """
    rows = ledger.withColumns({"_n": F.nullif(digits(F.col("number")), F.lit("")), "_c": F.nullif(F.trim("code"), F.lit(""))}).where("_n is not null")
    known = accounts.where(F.col("account_group").isin([*hidden, *mapped])).select("client_id", F.nullif(digits(F.col("account_no")), F.lit("")).alias("_n")).distinct()
    codes = accounts.select("client_id", F.nullif(F.trim("code"), F.lit("")).alias("_c")).distinct()
    left = rows.join(known, ["client_id", "_n"], "left_anti").join(codes, ["client_id", "_c"], "left_anti")
    return one_per_key(left, ["client_id", "_n"], [F.col("file"), F.col("code")]).select("client_id", F.col("_n").alias("number"), "file", "code", "name")


def without_hidden(rows: DataFrame, accounts: DataFrame, hidden: list[str]) -> DataFrame:
    """Rows whose client and account digits are not those of an account in a hidden group."""
    pairs = accounts.where(F.col("account_group").isin(hidden)).select("client_id", F.nullif(digits(F.col("account_no")), F.lit("")).alias("_n")).distinct()
    return rows.withColumn("_n", digits(F.col("number"))).join(pairs, ["client_id", "_n"], "left_anti").drop("_n")


def bank_sheet(rows: DataFrame) -> DataFrame:
    """The six columns of a bank sheet for each file in order, and mismatch: the balance before does not lead to this one."""
    checked = reconcile(rows, ["file"], ["seq"])
    return checked.select(
        "file", "seq", F.date_format("txn_date", "dd-MM-yyyy").alias("Date"), F.col("narration1").alias("Narration1"), F.col("narration2").alias("Narration2"),
        F.col("withdrawal").alias("Withdrawals"), F.col("deposit").alias("Deposits"), F.col("balance").alias("Balance"), F.col("balance_mismatch").alias("mismatch"),
    )


def ledger_sheet(rows: DataFrame, bank: Column, account_no: Column, ledger: Column) -> DataFrame:
    """The twelve columns of a ledger sheet: vouchers by bank, account and month, cash amounts in columns of their own."""
    named = rows.withColumns({"_bank": bank, "_ledger": first_filled(ledger, bank), "_cash": is_cash(F.concat("narration1", "narration2"))})
    prefix = F.concat("_bank", F.right(account_no, F.lit(2)), F.lit("-"), F.date_format("txn_date", "MMM"))
    out = voucher_serial(named, prefix, ["file", "seq"])
    split = lambda c, cash: F.when(F.col("_cash") == cash, F.col(c))
    return out.select(
        "file", "seq", F.lit("Main").alias("Type"), F.col("voucher").alias("Sr"), F.col("_ledger").alias("Bank"), F.date_format("txn_date", "dd-MM-yyyy").alias("Date"), F.lit("*Unknown*").alias("Account"),
        F.col("narration1").alias("Narration1"), F.col("narration2").alias("Narration2"), split("withdrawal", False).alias("Withdrawals"), split("deposit", False).alias("Deposits"),
        split("withdrawal", True).alias("CashWithdrawals"), split("deposit", True).alias("CashDeposits"), F.col("balance").alias("Balance"),
    )


def mailbox_totals(outcomes: DataFrame) -> DataFrame:
    """inserted, updated and existing of each mailbox (mailbox, outcome), and a row `all` with the sums. Rows without a mailbox are a mailbox null of their own."""
    count = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    sums = outcomes.rollup("mailbox").agg(*map(count, ("inserted", "updated", "existing")), F.grouping_id().alias("_all"))
    return sums.withColumn("mailbox", F.when(F.col("_all") == 1, "all").otherwise(F.col("mailbox"))).drop("_all")


def month_summary(status: DataFrame, group: str, key: str, months: list[str], value: str = "status") -> DataFrame:
    """One row for each key with a column for each month, and the spans in which a sheet would merge equal cells.

    status: group, key, month (one of months) and value. group_rows is the number of a group's rows on its first row (the least key) and 0 on others; runs has
    (value, span) of equal neighbours from left to right, a missing month being a value null. The months are given, so nothing is read to learn them; a
    group's size comes from counts, not from gathering its rows.
    """
    wide = status.groupBy(group, key).pivot("month", months).agg(F.max(value))
    cells = F.array(*(F.col(m) for m in months))
    starts = F.filter(F.sequence(F.lit(0), F.lit(len(months) - 1)), lambda i: (i == 0) | ~F.get("_cells", i).eqNullSafe(F.get("_cells", i - 1)))
    runs = F.transform("_starts", lambda s, n: F.struct(F.get("_cells", s).alias("value"), (F.coalesce(F.get("_starts", n + 1), F.lit(len(months))) - s).alias("span")))
    wide = wide.withColumn("_cells", cells).withColumn("_starts", starts).withColumn("runs", runs).drop("_cells", "_starts")
    sizes = wide.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_first")).withColumnRenamed(group, "_group")
    out = wide.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
    return out.select(group, key, F.when(F.col(key) == F.col("_first"), F.col("_rows")).otherwise(0).alias("group_rows"), *months, "runs")


def preview(rows: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The first n rows of each sheet, every cell as text and null as empty; Spark keeps n rows of a key before the shuffle."""
    head = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    out = rows.withColumn("_rn", head).where(F.col("_rn") <= n).drop("_rn")
    return out.select(key, seq, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns if c not in (key, seq)))
