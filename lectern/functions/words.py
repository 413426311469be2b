"""Word lists, patterns and thresholds that results depend on. All are fixed values."""

from __future__ import annotations

# Words that carry no topic, in English and Bengali.
STOP = frozenset(
    "a an the of to in on for and or is are was were be by with at as from that this it its what which who how when where do does did "
    "i you your please tell me about there here has have had can could would should been being also than then into their them they he "
    "she his her him many much long allowed required needed used given made written stated mentioned chosen sent taken held known form "
    "document page file letter "
    "কি কী কত কোন কোনো কোথায় কে কার কখন এর এই ও এবং আমি আমার আমরা হয় হবে হয়েছে জন্য থেকে করে করা একটি এটি তার তাদের সে না যে যদি আছে নং চাওয়া জানতে".split()
)
# Digits of the Bengali script and their ASCII counterparts; the script's range.
BN_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"
BENGALI = "ঀ-৿"
# Characters of a token, and those stripped from its ends.
TOKEN, TOKEN_EDGE = f"[a-z0-9{BENGALI}%$.@-]+", ".-@"
# Suffixes that are cut, first match first, and the letters that must remain.
SUFFIXES = (("ing", 4), ("ed", 4), ("es", 4), ("ly", 4), ("er", 4), ("s", 3))
# Words that begin a question, not a name.
QUESTION_WORDS = ("What", "Which", "Who", "When", "Where", "How", "Why", "Tell", "Give", "List", "Find", "Show")
# Paraphrases of whoever or whatever a document names.
ROLE_WORDS = frozenset(
    "customer customers applicant applicants client borrower person company he she show shows shown need needs needed required require "
    "requires name number amount price value figure cost sum worth".split()
)
# What forms call something that a question names otherwise.
FORM_SYNONYMS = {
    "work": ("employer", "organization", "organisation", "company", "occupation", "profession", "business", "employed"),
    "designation": ("position", "title", "post", "occupation", "rank", "profession"),
    "number": ("no", "nr", "num", "nbr", "id"),
    "tax": ("vat", "gst", "ppn", "pb1", "gross", "net"),
    "subtotal": ("sub", "total", "net"),
    "seller": ("from", "vendor", "supplier", "seller", "sold"),
    "client": ("bill", "buyer", "customer", "to", "billed", "ship"),
    "total": ("sum", "due", "balance", "grand"),
    "phone": ("tel", "telephone", "mobile", "cell"),
    "address": ("addr", "street"),
    "date": ("dated", "issued"),
    "invoice": ("inv", "bill"),
    "id": ("tax", "no", "number"),
    "worth": ("gross", "net", "total"),
    "name": ("seller", "client", "from", "to", "bill"),
}
# Constants of ranking, chunking, grounding and caching.
K1, B = 1.4, 0.75
CHUNK_TARGET, GATEWAY_SIZE, GATEWAY_OVERLAP, LINES_PER_PAGE = 450, 700, 120, 45
COVER_OK, SUPPORT_OK, CROSS_CAP, ABSENT_SHARE, ABSTAIN_COVERAGE = 0.80, 0.6, 0.55, 0.30, 0.75
BIG_CORPUS_PAGES, SHORT_PAGE, OCR_FLAG_BELOW, RECALL_JACCARD = 20, 3200, 0.90, 0.85
CACHE_FILLER = ("please", "can", "could", "would", "you", "tell", "me", "kindly", "the", "a", "an", "show", "give")
RECALL_FILLER = ("the", "a", "an", "of", "is", "what", "please")
# Question patterns.
META_Q = r"\b(describe|summari[sz]e|summary|overview|what kind|what type|what is this|explain|tell me about|about this)\b"
EXTRACT_Q = r"\b(extract|list all|all the|every|fields?|table of|summari[sz]e)\b"
VISUAL_Q = r"\b(describe|what is in|what color|what colour|photo|picture|image|logo|stamp|signature)\b"
LOOK_Q = r"\b(look|image|photo|picture|logo|signature|stamp|chart|graph|diagram|color|colour|handwrit\w*|checkbox|ticked|checked|shown|see)\b"
LIST_Q = r"\b(which|what) [a-z ]*(types|options|levels|brands|documents|products|facilities|sections|categories)\b|\blist\b"
NUMERIC_Q = r"how (many|much|long|old)|amount|salary|fee|rate|period|date|years?|number|percent|total|term"
NOT_FOUND = r"not found in the documents|not found in the pages read so far|cannot find|no information|not (mentioned|provided|stated)"
DATE_Q = r"\b(date|dob|birth|born|expiry|expire|issued|issue)\b"
MONEY_Q = r"\b(amount|salary|income|fee|price|total|balance|limit|loan amount|tk|bdt|taka)\b"
NUMBER_Q = r"\b(how (many|much|long|old)|number|age|years|months|term|phone|mobile|id|tin|code)\b"
ITEM_WORD = r"\b(item|items|section|clause|point|serial|row|line|no\.|number)\b|নং|ক্রমিক|ধারা|অনুচ্ছেদ|নম্বর"
OPTION_Q = r"\b(?:which|what|list)\b[^?]*?\b([a-z]+) (types?|options?|levels?|brands?|categories|category|kinds?)\b"
OPTION_SKIP = frozenset("the of what which are all different those these available many can is does do".split())
BOX_GLYPHS = "[■-◿☐-☒•·]"
# Glyphs that only legacy-encoded Bengali text holds, and how many mark such a text.
LEGACY_SIGNATURE, LEGACY_LEAST, LEGACY_SHARE = "†‡¨ªÖ¯³µÿÎËÄÝô¤‚…„›šˆ‰©·", 6, 0.03
# Amounts of money, and what receipts call the rows that hold them.
MONEY = r"(?<![\w.,-])(?:[$€£]|rp\.?|tk\.?|bdt|usd)?\s?\d{1,3}(?:[.,] ?\d{3})+(?:[.,]\d{1,2})?(?![\w%]|[.,]\d)|(?<![\w.,-])\d+(?:[.,]\d{1,2})?(?![\w%]|[.,]\d)"
TOTAL_LABELS = ("grand total", "total", "total sales", "net total", "total payable", "amount due", "balance due", "total due", "jumlah", "total amount")
SUB_LABELS = ("sub total", "subtotal", "subttl", "sub ttl", "sub-total", "total before tax", "net amount")
TAX_LABELS = ("tax", "vat", "gst", "ppn", "pb1", "pb-1", "pb", "pb 1", "pajak", "pajak resto", "sales tax", "service charge")
SUBWORD = r"\bsub|sub ?t|discount|before|items?|qty"
NOT_SUB = r"\btotal\b.*\btotal\b|sub ?total.*\btotal\b|\btax\b|\bpajak\b"
# Questions that are answered from a receipt's rows.
SIMPLE_Q = r"^\s*(?:what|how much)\s+(?:is|was|are)\s+the\s+((?:grand |net |final |sub ?)?total|subtotal|sub-total|tax|vat|gst|service charge|amount due|balance due)(?:\s+(?:amount|due|payable|price|value))?\s*\??\s*$"
PRICE_Q = r"^\s*(?:what|how much)\s+(?:is|was)\s+the\s+(?:price|cost|amount)\s+(?:of|for)\s+(.+?)\s*\??\s*$"
COLUMN_Q = r"^\s*(?:what|how much)\s+(?:is|was)\s+the\s+total\s+([a-z][a-z %\[\]]{1,30}?)\s*\??\s*$"
TAX_WORDS, NOT_COLUMNS = ("tax", "vat", "gst", "servicecharge"), ("amount", "price", "value", "due", "sum")
# Least spelling ratios of row labels, item words, quoted labels, a row's words and near misses; share of an item's words.
LABEL_RATIO, WORD_RATIO, QUOTED_RATIO, ROW_RATIO, NEAR_MISS, ITEM_SHARE = 0.82, 0.80, 0.84, 0.85, 0.78, 0.6
# How questions name a form's label, and what ends or spoils its value.
QUOTED = r"['\"‘“](.{1,60})['\"’”]"
VALUE_OF = r"\bvalue (?:of|for)\b"
PLAIN = r"^\s*what(?:'s| is| was)\s+(?:the\s+)?([a-z][a-z0-9 '#&/.()-]{1,48}?)\s*\??\s*$"
WHO = r"^\s*who(?:'s| is| was)\s+the\s+([a-z][a-z0-9 '#&/.()-]{1,48}?)\s*\??\s*$"
BOXES = "[■-◿☐-☒✓✔✗✘]"
NEXT_LABEL = r"(?<=[\s0-9a-z])[A-Z][A-Za-z'#&/.]*(?: [A-Za-z'#&/.]+){0,3} ?:(?!\d)"
GENERIC = ("name", "date", "value", "number", "type", "amount", "total", "address", "title", "status")
# How follow-up questions begin, words with which a question stands alone, and small talk.
LEAD = r"^\s*(?:ok(?:ay)?,?\s*|then\s+|so\s+)?(?:and|also|what about|how about|and what about|and how about)\s+(.+?)\s*\??\s*$"
QWORD = r"^\s*(what|which|who|whom|whose|when|where|why|how|is|are|was|were|do|does|did|can|could|would|will|should|list|show|give|tell|describe|summari[sz]e|extract|find|explain|compare|please)\b"
PRON = r"\b(his|her|their|its)\b"
FRAME = r"^\s*((?:what|which|who|when|where|how much|how many)\s+(?:is|are|was|were)\s+)"
NAME = r"(?<![A-Za-z])[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+)+"
SMALL_TALK = ("thanks", "thank you", "thank you so much", "thx", "ok", "okay", "hi", "hello", "bye", "yes", "no", "great", "cool", "nice", "good", "fine", "sure", "got it")
NOT_NAMES = ("What", "Which", "Who", "When", "Where", "Why", "How", "Is", "Are", "Was", "The")
# Words too common to find a row by.
ROW_GENERIC = ("what", "which", "applicant", "customer", "client", "form", "document", "this", "that", "the", "loan", "name")
