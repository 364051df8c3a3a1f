"""The words column names are read by, and the words text columns use for missing."""

from __future__ import annotations

import re

# Text that stands for a missing value (matched upper-cased and trimmed).
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NAN", "1.#IND", "1.#QNAN", "N/A",
           "NA", "NAN", "NULL")

# Text that people type where a value should be (lower-cased and trimmed).
PLACEHOLDERS = ("unknown", "n/a", "na", "none", "null", "nil", "-", "--", "?", "missing",
                "not available", "tbd", "#n/a", "(blank)", "undefined", "not known", "(not set)",
                "not set", "(not provided)", "not provided", "(unknown)")

# Labels of subtotal rows.
SUBTOTALS = ("total", "grand total", "subtotal", "sub total", "all", "overall")

# One class of name words per line, each the meaning a measure's name gives away.
CLASSES = {
    "code": "code dow ean fips hour isbn month phone pin pincode postal postcode quarter upc week "
            "weekday year yr zip zipcode",
    "per_row": "age aov arppu arpu average avg bid cpa cpc cpi cpl cpm cpo cpv ctr cvr fare "
               "frequency grade index lat latitude lng lon long longitude margin mean median nps "
               "pct percent percentage price prob probability rate rating ratio roas roi salary "
               "score share tariff temp temperature wage yield",
    "lat": "lat latitude",
    "lng": "lng lon long longitude",
    "distance": "dist distance kilometers kilometres km kms meters metres mi mileage miles mtrs "
                "odometer",
    "discrepancy": "accuracy delta deviation diff drift drop err error gap gps jitter offset "
                   "precision radius variance",
    "taken": "cycle delay delayed delivery dispatch eta handling latency lead leadtime prep "
             "preparation processing recorded resolution response sla transit turnaround wait "
             "waiting",
    "snapshot": "arr backlog balance capacity fans followers headcount inventory level licences "
                "licenses listsize members mrr onhand open outstanding population position seats "
                "snapshot stock subscribers",
    "flow": "added change churn churned contraction decrease delta downgrade expand expansion "
            "gained growth increase inflow lost movement net new outflow reactivation removed "
            "upgrade",
    "money": "amount amt charge cost discount fee fees gmv income paid payment price profit refund "
             "revenue sales spend tax value",
    "converted": "aed aud base cad chf cny converted eur fx gbp inr jpy normalised normalized "
                 "reporting sgd usd",
    "ratio": "aov arppu arpu average avg bid cpa cpc cpi cpl cpm cpo cpv ctr cvr frequency mean "
             "median pct percent percentage price rate ratio roas roi share",
    "people": "audience dau distinct mau reach unique uniques wau",
    "credit": "allocated allocation attributed attribution credit",
    "duration": "day days delay duration elapsed hours hrs latency leadtime mins minutes seconds "
                "secs tenure",
    "additive": "aed amount amt applications bookings bounces budget calls charge clicks comments "
                "commission complaints conversion conversions cost count delivered discount "
                "downloads eur expense fee fees freight gbp gmv gross impressions income inr "
                "installs items jpy leads likes net opens orders pages paid payment posts profit "
                "purchases qty quantity reactions refund registrations replies revenue sales sends "
                "sent sessions shares shipping signups spend subtotal tax total transactions "
                "turnover units unsubscribes usd value viewed views visits volume weight",
}
WORDS = {name: frozenset(text.split()) for name, text in CLASSES.items()}

# Name words of an identifier, of an entity, and of a percentage.
IDENTIFIER = frozenset("id ids key code codes uuid guid no num number sku ref".split())
ENTITY = frozenset("id key number no sku uuid".split())
PERCENT = frozenset("pct percent percentage rate ratio ctr cvr share".split())

# Names that point at personal data.
PII = {"email": ("email", "e_mail", "mail_id"),
       "phone": ("phone", "mobile", "contact_no", "whatsapp"),
       "name": ("customer_name", "full_name", "first_name", "last_name"),
       "address": ("address", "street", "landmark"),
       "government_id": ("aadhaar", "pan", "gstin")}


def snake(name: str) -> str:
    """customerName -> customer_name; anything not a letter or digit separates words."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return "_".join(p for p in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if p)


def words_of_name(name: str) -> set[str]:
    """The words of a column name; digits end a word."""
    return {w for part in snake(name).split("_") for w in re.findall(r"[a-z]+", part)}


def joined_words(name: str) -> set[str]:
    """Neighbouring words of a name written as one: qty_on_hand holds onhand."""
    words = [w for w in snake(name).split("_") if w]
    return {a + b for a, b in zip(words, words[1:])}


def pii_class(name: str) -> str | None:
    norm = snake(name)
    parts = norm.split("_")
    for kind, hints in PII.items():
        for h in hints:
            if norm == h or h in parts or ("_" in h and h in norm):
                return kind
    return None
