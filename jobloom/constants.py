"""Fixed values that must equal the reference behaviour for equal results.

Everything here is data, stated once, in natural order.
"""

# --- fixed values: base URL of the job board that links are resolved against
BOARD_BASE_URL = "https://www.indeed.com"

# --- fixed values: target region countries (vendor A asks lower-case) -------
TARGET_COUNTRIES = ["Taiwan", "China", "Singapore", "Hong Kong"]

# --- fixed values: default preferred cities of the ranking ------------------
DEFAULT_PREFERRED_CITIES = ["Taipei", "Hsinchu", "Taichung", "Beijing", "Shanghai",
                            "Shenzhen", "Hangzhou", "Singapore", "Hong Kong"]

# --- fixed values: city gazetteer per country, in search order -------------
CITY_GAZETTEER = [
    ("Taiwan", ["Taipei", "Hsinchu", "Taichung", "Tainan", "Kaohsiung"]),
    ("China", ["Beijing", "Shanghai", "Shenzhen", "Guangzhou", "Hangzhou", "Chengdu"]),
    ("Singapore", ["Singapore"]),
    ("Hong Kong", ["Hong Kong"]),
]

# --- fixed values: company-size buckets (upper bound inclusive, label) -----
SIZE_BUCKETS = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"),
                (1000, "501-1000"), (5000, "1001-5000")]
SIZE_TOP_LABEL = "5000+"

# --- fixed values: title synonym folding, applied in this order ------------
TITLE_FOLDS = [("senior", "sr"), ("junior", "jr"), ("remote", ""), ("hybrid", "")]

# --- fixed values: legal suffix pattern stripped when inferring a website --
LEGAL_SUFFIX_ALTERNATIVES = r"(inc\.?|llc\.?|ltd\.?|corp\.?|corporation|company|co\.?)"

# --- fixed values: embedded job-card JSON marker of a search page ----------
EMBEDDED_MARKER_PATTERN = (
    r'window\.mosaic\.providerData\["mosaic-provider-jobcards"\]\s*=\s*(\{.*?\});')

# --- fixed values: blocked / challenge page markers ------------------------
CHALLENGE_MARKERS = ["challenges.cloudflare.com", "Verify you are human", "Just a moment",
                     "cf-challenge"]
CHALLENGE_PHRASES_CI = ["verify you", "captcha"]
SUSPICIOUS_PAGE_CHARS = 5000
BLOCKED_ATTR_PATTERN = r"(blocked|access.*denied)"
BLOCKED_HEADING_PATTERN = r"(blocked|access.*denied|unusual traffic)"
CAPTCHA_CLASS_PATTERN = r"(recaptcha|captcha-container|hcaptcha)"
CAPTCHA_TEXT_PATTERN = r"(verify you.re human|solve.*captcha|complete.*verification)"

# --- fixed values: salary scaling ------------------------------------------
HOURS_PER_YEAR = 2080
SALARY_PATTERN = r"\$?([\d,]+(?:\.\d{2})?)\s*[kK]?"

# --- fixed values: per-company caps of the vendor searches and the UI ------
VENDOR_PEOPLE_CAP = 100

# --- fixed values: Python str.isspace() characters as a regex class body ---
# (shared by Java regex and RE2 so Spark and DuckDB agree with Python)
PY_SPACE_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Python's \w: letters, numbers and the underscore
PY_WORD_CLASS = r"\p{L}\p{N}_"
