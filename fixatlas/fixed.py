"""Fixed values.

Everything in this module is a constant that has to equal the value used by the
data it describes (URL markers, lookup words, patterns, month names).  They are
kept together, in plain text and natural order, so that a change upstream is a
change here and nowhere else.  Functions take them as defaults; pass your own
to work with other sites.
"""

# Hosts of the documentation sites, stripped from or put in front of paths.
DOCS_HOST = "https://docs.paloaltonetworks.com"
LOCALE_ROOT = "/content/techdocs/en_US"

# URL fragments that name a product.  Longest contained fragment wins.
PRODUCT_PREFIXES = [
    ("panos", "/pan-os/"),
    ("panos", "/ngfw/release-notes/"),
    ("globalprotect", "/globalprotect/release-notes/"),
    ("prisma-access", "/prisma-access/"),
    ("prisma-access-agent", "/gp-app-for-prisma-access/"),
    ("prisma-access-agent", "/prisma-access-agent/"),
    ("prisma-access-agent", "/prisma-access-app/"),
    ("prisma-sdwan", "/prisma-sd-wan/"),
    ("cloud-ngfw-azure", "/cloud-ngfw-azure/"),
    ("cloud-ngfw-aws", "/cloud-ngfw-aws/"),
    ("remote-browser-isolation", "/remote-browser-isolation/"),
    ("ai-access-security", "/ai-access-security/"),
    ("ai-runtime-security", "/ai-runtime-security/"),
    ("strata-logging-service", "/strata-logging-service/"),
    ("device-security", "/iot/release-notes/"),
    ("enterprise-dlp", "/enterprise-dlp/"),
    ("adem", "/autonomous-dem/"),
    ("scm", "/strata-cloud-manager/"),
    ("sdwan-plugin", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-sd-wan"),
    ("vm-series-plugin", "/plugins/vm-series-and-panorama-plugins-release-notes/vm-series-plugin"),
    ("plugin-aws", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-aws"),
    ("plugin-azure", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-azure"),
    ("plugin-gcp", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-gcp"),
    ("plugin-vmware-nsx", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-vmware-nsx"),
    ("plugin-vmware-vcenter", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-vmware-vcenter"),
    ("plugin-kubernetes", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-kubernetes"),
    ("plugin-cisco-aci", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-cisco-aci"),
    ("plugin-cisco-trustsec", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-cisco-trustsec"),
    ("plugin-ztp", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-zero-touch-provisioning"),
    ("plugin-clustering", "/plugins/vm-series-and-panorama-plugins-release-notes/panorama-plugin-for-clustering"),
]

# Slug fragments after which a plugin URL carries its version, tried in order.
PLUGIN_SLUGS = [
    ("vm-series-plugin", "vm-series-plugin-"),
    ("vm-series-plugin", "vmseries-plugin-"),
    ("plugin-aws", "aws-plugin-"),
    ("plugin-aws", "panorama-plugin-for-aws-"),
    ("plugin-azure", "azure-plugin-"),
    ("plugin-azure", "panorama-plugin-for-azure-"),
    ("plugin-gcp", "gcp-plugin-"),
    ("plugin-gcp", "panorama-plugin-for-gcp-"),
    ("plugin-vmware-nsx", "nsx-plugin-"),
    ("plugin-vmware-nsx", "vmware-nsx-plugin-"),
    ("plugin-vmware-nsx", "panorama-plugin-for-vmware-nsx-"),
    ("plugin-vmware-vcenter", "vcenter-plugin-"),
    ("plugin-vmware-vcenter", "panorama-plugin-for-vmware-vcenter-"),
    ("plugin-kubernetes", "kubernetes-plugin-"),
    ("plugin-kubernetes", "panorama-plugin-for-kubernetes-"),
    ("plugin-cisco-aci", "aci-plugin-"),
    ("plugin-cisco-aci", "panorama-plugin-for-cisco-aci-"),
    ("plugin-cisco-trustsec", "trustsec-plugin-"),
    ("plugin-cisco-trustsec", "panorama-plugin-for-cisco-trustsec-"),
    ("plugin-ztp", "ztp-plugin-"),
    ("plugin-ztp", "zero-touch-provisioning-"),
    ("plugin-clustering", "clustering-plugin-"),
    ("plugin-clustering", "panorama-plugin-for-clustering-"),
]

# Fragments that mark a page as an issue page.
ISSUE_MARKERS = [
    "known-issues",
    "addressed-issues",
    "known-and-addressed",
    "fixed-issues",
    "known-issue",
    "addressed-issue",
]

# Words after a version triple in a URL that are not a version suffix.
SLUG_NON_SUFFIXES = ["known", "addressed", "issues", "and"]
TEXT_NON_SUFFIXES = ["known", "addressed", "issues"]

# Scope of the page trees that are filtered by marker, not by prefix.
DLP_OUT_OF_SCOPE = [
    "known-issues-in-endpoint-dlp",
    "known-issues-in-the-enterprise-dlp-cloud-service",
]
TS_TREE_MARKER = "/terminal-services-agent-release-notes/"
TS_PAGE_MARKERS = [
    "known-issues-in-ts-agent",
    "-addressed-issues",
    "terminal-services-ts-agent-release-information-",
]
SPACE_PATTERN = r"(?i)^(?:xdr-agent-release-notes|\d+\.x|\d+\.\d+(?:-?ce)?(?:-eol)?)(?:/|$)"

# URL template of the release-note pages addressed by a major slug.
SDWAN_KNOWN_TEMPLATE = (
    "/sd-wan/release-notes/panorama-plugin-for-sd-wan/sd-wan-plugin-%1$s"
    "/known-issues-in-sd-wan-plugin-%1$s"
)

# Identifier shapes (split, validation, quality check, two-column tables).
BUG_ID_SPLIT = r"[A-Z]+-\d{3,}"
BUG_ID_VALID = r"^[A-Z]+-\d+$"
BUG_ID_QUALITY = r"^[A-Z][A-Z0-9]*-\d+$"
BUG_ID_ARIA = r"[A-Z][A-Z0-9]*-\d+"
VERSION_QUALITY = r"^\d+\.\d+(?:\.\d+)?(?:-[a-z0-9]+)?$"

# Products whose version strings may break VERSION_QUALITY.
VERSION_TOLERATED = [
    "scm",
    "cortex-xdr",
    "ai-access-security",
    "ai-runtime-security",
    "strata-logging-service",
    "device-security",
    "enterprise-dlp",
    "prisma-access",
    "prisma-access-agent",
    "sdwan-plugin",
    "remote-browser-isolation",
    "cloud-ngfw-aws",
    "cloud-ngfw-azure",
    "adem",
]

# Months as written in headings.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

# ARIA tables - header words, platform spellings, "no platform" values.
ARIA_HEADER_WORDS = [
    "issue", "issues", "issue id", "bug", "bug id", "id",
    "description", "details", "limitation", "limitations",
    "platform", "platforms", "summary",
]
PLATFORMS = [
    ("windows", "Windows"),
    ("linux", "Linux"),
    ("macos", "macOS"),
    ("mac", "macOS"),
    ("android", "Android"),
    ("ios", "iOS"),
]
NON_PLATFORMS = ["general", "all", "n/a", "-", ""]

# Section headings.
SECTION_COMPONENTS = [
    "Configuration Management",
    "Command Center",
    "Insights",
    "Activity",
    "Health",
    "Incidents",
    "Policy",
    "Tenancy",
    "Identity",
    "Objects",
    "Workflows",
    "Network",
    "SASE",
]
FEATURE_HEADING_SKIPS = ["release notes", "issues", "table of contents"]
MULTITENANT_PAGE = "/prisma-sase-multitenant-platform/release-updates/"
MULTITENANT_COMPONENT = "Strata Multitenant Cloud Manager"

# Literal versions, and the ones hidden in display.
VERSION_SAAS = "SaaS"
VERSION_UNKNOWN = "Unknown"
HIDDEN_VERSIONS = [VERSION_SAAS, VERSION_UNKNOWN]

# Phrases that make a fix text redundant in display.
REDUNDANT_FIX_PHRASES = ["this issue is", "resolved in", "addressed in"]

# Characters escaped for HTML, ampersand first.
HTML_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#39;"),
    ("/", "&#x2F;"),
]

# Cache lifetime, list lengths, snapshot format.
CACHE_TTL_HOURS = 24
MISSING_IDS_SHOWN = 10
SAMPLE_IDS_SHOWN = 5
VERSIONS_SHOWN = 20
PAGE_SIZE = 50
SNAPSHOT_SCHEMA_VERSION = 1
