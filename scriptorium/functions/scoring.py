"""An additive score of messages: each signal is a condition with a weight; reasons name the ones that fired.

One projection of CASE expressions over a canonical message record: no functions, no higher-order lambdas on the
score itself, so it stays inside whole-stage code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each signal adds.
WEIGHTS = {
    "social_network": -3,
    "marketing_domain": -2,
    "newsletter_header": -2,
    "html_only": -2,
    "noreply": -1,
    "promotional_subject": -2,
    "own_domain": 2,
    "sent": 2,
    "actionable_subject": 3,
    "document_attached": 2,
    "government": 2,
    "reply": 1,
    "near_empty": -1,
    "trivial_notice": -1,
    "actionable_body_many": 2,
    "actionable_body": 1,
    "noreply_without_action": -1,
    "marketing_address": -1,
    "personal_sender": 1,
    "newsletter_body": -1,
    "cc_only": -1,
    "generic_address": -1,
}


@dataclass(frozen=True)
class Rules:
    """Lists, patterns (any case) and limits; all of them configuration."""

    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    social_domains: Sequence[str] = ("social.example.com",)
    marketing_domains: Sequence[str] = ("campaign.example.com",)
    own_domains: Sequence[str] = ("home.example.org",)
    government_suffixes: Sequence[str] = ("gov", "gov.example")
    sent_folders: Sequence[str] = ("sent", "sent messages", "envoyés")
    ignored_folders: Sequence[str] = ("spam",)
    document_extensions: Sequence[str] = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
    promotional_subjects: Sequence[str] = (r"\b(?:discount|sale|promo)\b", r"\bunsubscribe\b", r"last chance", r"\b(?:weekly|monthly|daily)\s+(?:digest|recap|newsletter)")
    actionable_subjects: Sequence[str] = (r"invoice|facture", r"contract|contrat", r"deadline|due date", r"appointment|rendez-vous", r"\baction required\b", r"payment|paiement")
    trivial_subjects: Sequence[str] = (r"\b(?:verification code|one.time)\b", r"\bnew sign.?in\b", r"\breset.*password\b")
    actionable_bodies: Sequence[str] = (r"\d[\d ]*[,.]\d{2} *(?:\$|CAD|USD|EUR)", r"(?:no\.|#) *(?:order|contract|account)", r"\d{4}-\d{2}-\d{2}", r"(?:deadline|due|before the) ")
    noreply: str = r"(?:noreply|no-reply|no_reply|donotreply|do-not-reply)"
    marketing_addresses: Sequence[str] = (r"^(?:marketing|promo|news|campaign|digest)@", r"@(?:mail|email|send|notifications?)\.")
    newsletter_bodies: Sequence[str] = (r"\bunsubscribe\b", r"\bopt[- ]?out\b", r"all rights reserved", r"privacy policy", r"view.*in.*browser")
    generic_addresses: Sequence[str] = (r"^(?:info|hello|contact|support|admin|sales|notification|alert)@", r"^(?:team|updates?|system|bounce|mailer|postmaster|webmaster)@")
    personal_sender: str = r"^[a-z]+[.\-][a-z]+@"
    min_body: int = 50
    preview: int = 1000
    capture: int = 0
    ignore: int = -1

    def with_weight(self, **weights: int) -> Rules:
        return replace(self, weights=self.weights | weights)


def _any(patterns: Sequence[str]) -> str:
    return "(?iu)(?:" + "|".join(patterns) + ")"


def signals(rules: Rules, frm: Column, subject: Column, body: Column, folder: Column, to: Column, cc: Column, html_only: Column, has_list_unsubscribe: Column, has_document: Column) -> dict[str, Column]:
    """Whether each signal fired, in the order of reasons. Null inputs count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    sender, title, words = F.lower(text(frm)), text(subject), text(body)
    at = F.when(sender.contains("@"), F.substring_index(sender, "@", -1)).otherwise("")
    preview = F.substring(words, 1, rules.preview)
    among = lambda c, values: c.isin(*[v.lower() for v in values]) if values else F.lit(False)
    some = lambda c, patterns: c.rlike(_any(patterns)) if patterns else F.lit(False)
    hits = F.lit(0)
    for p in rules.actionable_bodies:
        hits = hits + preview.rlike(f"(?iu){p}").cast("int")
    noreply = sender.rlike(f"(?iu){rules.noreply}")
    generic = some(sender, rules.generic_addresses)
    holds = lambda c: some(F.lower(text(c)), [d.lower().replace(".", r"\.") for d in rules.own_domains])
    suffix = "(?:^|\\.)(?:" + "|".join(s.lower().lstrip(".").replace(".", r"\.") for s in rules.government_suffixes) + ")$"
    return {
        "social_network": among(at, rules.social_domains),
        "marketing_domain": among(at, rules.marketing_domains),
        "newsletter_header": yes(has_list_unsubscribe),
        "html_only": yes(html_only),
        "noreply": sender.contains("noreply") | sender.contains("no-reply"),
        "promotional_subject": some(title, rules.promotional_subjects),
        "own_domain": among(at, rules.own_domains),
        "sent": among(F.lower(text(folder)), rules.sent_folders),
        "actionable_subject": some(title, rules.actionable_subjects),
        "document_attached": yes(has_document),
        "government": at.rlike(suffix) if rules.government_suffixes else F.lit(False),
        "reply": title.rlike("(?i)^(?:re|fwd|tr|ref):"),
        "near_empty": F.length(F.regexp_replace(words, r"\A\s+|\s+\z", "")) < rules.min_body,
        "trivial_notice": some(title, rules.trivial_subjects),
        "actionable_body_many": hits >= 2,
        "actionable_body": hits == 1,
        "noreply_without_action": noreply & (hits == 0),
        "marketing_address": some(sender, rules.marketing_addresses),
        "personal_sender": sender.rlike(rules.personal_sender) & ~generic & ~noreply,
        "newsletter_body": some(preview, rules.newsletter_bodies),
        "cc_only": holds(cc) & ~holds(to),
        "generic_address": generic,
    }


def score(fired: dict[str, Column], weights: dict[str, int]) -> Column:
    total = F.lit(0)
    for name, on in fired.items():
        total = total + F.when(on, weights[name]).otherwise(0)
    return total.cast("long")


def reasons(fired: dict[str, Column], weights: dict[str, int]) -> Column:
    """'name [+w]' of the signals that fired, in order, joined by ';'."""
    return F.concat_ws(";", *(F.when(on, F.lit(f"{name} [{weights[name]:+d}]")) for name, on in fired.items()))


def band(total: Column, rules: Rules) -> Column:
    return F.when(total >= rules.capture, "captured").when(total <= rules.ignore, "ignored").otherwise("grey")


def score_messages(messages: DataFrame, rules: Rules) -> DataFrame:
    """messages with score, reasons and band. Columns read: from_addr, subject, body, folder, to, cc, is_html_only, headers, attachments."""
    has_document = F.exists("attachments", lambda a: F.lower(F.substring_index(a["filename"], ".", -1)).isin(*rules.document_extensions) & a["filename"].contains("."))
    header = F.length(F.coalesce(F.try_element_at("headers", F.lit("list-unsubscribe")), F.lit(""))) > 0
    fired = signals(rules, *(F.col(c) for c in ("from_addr", "subject", "body", "folder", "to", "cc", "is_html_only")), header, has_document)
    out = messages.withColumn("score", score(fired, rules.weights)).withColumn("reasons", reasons(fired, rules.weights))
    return out.withColumn("band", band(F.col("score"), rules))


def problems(rules: Rules) -> list[str]:
    """What is wrong with a configuration: patterns that don't compile, thresholds out of order, weights that aren't whole."""
    import re

    out = []
    for name in ("promotional_subjects", "actionable_subjects", "trivial_subjects", "actionable_bodies", "marketing_addresses", "newsletter_bodies", "generic_addresses"):
        for p in getattr(rules, name):
            try:
                re.compile(p)
            except re.error as e:
                out.append(f"{name}: {p}: {e}")
    if rules.capture <= rules.ignore:
        out.append("capture must exceed ignore")
    out += [f"weight {k} isn't whole" for k, v in rules.weights.items() if not isinstance(v, int)]
    out += [f"unknown weight {k}" for k in rules.weights if k not in WEIGHTS]
    return out


def changed(rules: Rules, dry_run: bool = True, **changes) -> tuple[Rules, list[tuple[str, object, object]]]:
    """(rules, diff) after typed changes, all or none; weights are given as weight_<name>. A dry run returns the old rules."""
    weights = {k.removeprefix("weight_"): v for k, v in changes.items() if k.startswith("weight_")}
    fields = {k: v for k, v in changes.items() if not k.startswith("weight_")}
    new = replace(rules, **fields).with_weight(**weights)
    if wrong := problems(new):
        raise ValueError("; ".join(wrong))
    diff = [(f"weight_{k}", rules.weights.get(k), v) for k, v in weights.items() if rules.weights.get(k) != v]
    diff += [(k, getattr(rules, k), v) for k, v in fields.items() if getattr(rules, k) != v]
    return (rules if dry_run else new), diff
