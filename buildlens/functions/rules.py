"""Feature names, keywords, detection patterns, trusted hosts, thresholds.

Nothing here is logic.  The tables are kept together so that a deployment can
review or replace them; every operator takes the table it uses as a parameter.
"""

# --- fixed values: feature vectors -----------------------------------------
FEATURE_NAMES = [
    "duration_seconds", "log_line_count", "char_density", "error_count",
    "warning_count", "step_count", "unique_templates", "template_entropy",
    "suspicious_pattern_count", "external_ip_count", "external_url_count",
    "base64_pattern_count",
]

STANDARD_STEPS = [
    "checkout", "setup_environment", "install_dependencies",
    "run_tests", "build_artifact", "deploy",
]

FEATURE_NAMES_16 = [
    "duration_seconds", "log_line_count", "char_density", "error_count",
    "warning_count", "step_count",
    "event_checkout", "event_setup_environment", "event_install_dependencies",
    "event_run_tests", "event_build_artifact", "event_deploy",
    "unique_ips_contacted", "external_urls_count", "base64_patterns",
    "suspicious_commands",
]

# --- fixed values: keywords -------------------------------------------------
ERROR_KEYWORDS = ["error", "failed", "failure", "exception", "fatal", "critical"]
WARNING_KEYWORDS = ["warning", "warn", "deprecated", "caution"]
JOB_ERROR_KEYWORDS = ["error", "failed", "exception"]
JOB_WARNING_KEYWORDS = ["warning", "warn"]
GENERATED_WARNING_KEYWORDS = ["warning", "warn", "deprecated"]

# --- fixed values: security patterns (case-insensitive, whole text) ----------
SUSPICIOUS_PATTERNS = [
    r"curl.*-X\s*POST",
    r"wget.*--post",
    r"nc\s+(-e|-c)",
    r"bash\s+-i",
    r"/dev/tcp/",
    r"mkfifo",
    r"xmrig|minerd|cryptonight",
    r"stratum\+tcp://",
    r"hashrate",
    r"cat\s+/etc/(passwd|shadow)",
    r"\$\([^)]+\)",
]

SUSPICIOUS_COMMANDS_STRICT = [
    r"curl\s+.*-X\s+POST",
    r"wget\s+.*--post",
    r"\bnc\s+(-e|-c)\b",
    r"bash\s+-i\b",
    r"/dev/tcp/",
    r"\bmkfifo\b",
    r"\bxmrig\b",
    r"\bminerd\b",
    r"\bcryptonight\b",
    r"stratum\+tcp://",
    r"cat\s+/etc/passwd",
    r"cat\s+/etc/shadow",
    r"(?:^|;|\|)\s*eval\s+",
]

SUSPICIOUS_LINE_PATTERNS = [
    r"\bxmrig\b|\bcryptonight\b|\bminerd\b|stratum\+tcp://|\bhashrate\s*:",
    r"\bnc\s+-[elp]\s|/bin/sh\s+-i|reverse[._-]?shell",
    r"curl.*--data.*secret|wget.*--post.*passwd|exfil",
]

BASE64_PATTERN = (
    r"(?:base64\s*(?:-d|-decode|--decode)"
    r"|echo\s+[\"']?[A-Za-z0-9+/]{50,}={0,2}"
    r"|\|\s*base64)"
)
BASE64_STRICT_PATTERN = r"(?:base64\s+(?:-d|-decode)?|[A-Za-z0-9+/]{50,}={1,2})"
BASE64_LINE_PATTERN = r"[A-Za-z0-9+/]{40,}={0,2}"

# --- fixed values: addresses -------------------------------------------------
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IP_OCTET_PATTERN = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)
NON_PUBLIC_PREFIXES_STRICT = ["0.", "127.", "10.", "192.168.", "172.", "1.", "2.", "3."]
NON_PUBLIC_PREFIXES_GENERATED = ["127.", "10.", "192.168.", "172."]
URL_PATTERN = r"https?://([^\s<>\"']+)"
HOST_PATTERN = r"https?://([a-zA-Z0-9.-]+)"

# --- fixed values: variables masked before template mining, in order ----------
MASK_PATTERNS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"\d{2}:\d{2}:\d{2}", "<TIME>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b[0-9a-fA-F]{40}\b", "<SHA1>"),
    (r"\b[0-9a-fA-F]{64}\b", "<SHA256>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    # Written for whole multi-line texts: a line break on the right is no neighbour,
    # and the first look-ahead passes over all other characters quickly.
    (r"(?=[-+\p{Nd}])(?<![a-zA-Z0-9])-?\+?\p{Nd}+(?=[^a-zA-Z0-9\n])", "<NUM>"),
    (r"\b\d+\.\d+\.\d+\b", "<VERSION>"),
    (r"https?://\S+", "<URL>"),
    (r"/[\w./\-]+", "<PATH>"),
]
# A text without any of these matches none of the patterns above.
MASKED_CHARACTERS = r"[\p{Nd}/]|[a-fA-F]{12}"
TOKEN_DELIMITERS = r"[\s=:,;|\[\](){}]+"

# --- fixed values: step markers, first match wins ------------------------------
STEP_MARKERS = [
    r"^##\[group\](.+)$",
    r"^=== Step: (.+) ===$",
    r"^Running (.+)\.\.\.$",
    r"^\s*❯\s*(.+)$",
]

# --- fixed values: template mining ------------------------------------------------
TEMPLATE_PREFIX_TOKENS = 3
TEMPLATE_SIMILARITY = 0.4
TEMPLATE_MAX_CHILDREN = 100

# --- fixed values: hosts whose URLs are not counted as external ----------------------
TRUSTED_DOMAINS = [
    # source hosting
    "github.com", "githubusercontent.com", "github.io", "githubassets.com",
    "pipelines.actions.githubusercontent.com",
    "actions-results.githubusercontent.com",
    "objects.githubusercontent.com",
    "codeload.github.com",
    # JavaScript packages
    "npmjs.org", "npmjs.com", "registry.npmjs.org", "npm.pkg.github.com",
    "yarnpkg.com", "registry.yarnpkg.com",
    "unpkg.com", "esm.sh", "skypack.dev", "deno.land",
    # Python packages
    "pypi.org", "files.pythonhosted.org", "pypi.python.org",
    # JVM packages
    "maven.org", "mavencentral.org", "jfrog.io", "repo1.maven.org", "search.maven.org",
    "repo.maven.apache.org", "maven.apache.org",
    "central.sonatype.com", "oss.sonatype.org", "s01.oss.sonatype.org",
    "gradle.org", "plugins.gradle.org", "services.gradle.org",
    # other packages
    "rubygems.org", "bundler.io",
    "crates.io", "static.rust-lang.org", "static.crates.io",
    "nuget.org", "api.nuget.org",
    "packagist.org", "getcomposer.org",
    "pkg.go.dev", "proxy.golang.org", "sum.golang.org", "gopkg.in",
    # container registries
    "docker.io", "docker.com", "registry.hub.docker.com", "hub.docker.com",
    "gcr.io", "ghcr.io", "quay.io", "mcr.microsoft.com",
    "index.docker.io", "auth.docker.io", "production.cloudflare.docker.com",
    # clouds
    "amazonaws.com", "s3.amazonaws.com", "cloudfront.net",
    "googleapis.com", "google.com", "gstatic.com", "storage.googleapis.com",
    "microsoft.com", "azure.com", "visualstudio.com", "azureedge.net",
    "blob.core.windows.net", "windowsupdate.com",
    # content delivery
    "cloudflare.com", "cloudflare-ipfs.com",
    "fastly.net", "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com",
    "bootstrapcdn.com", "fontawesome.com", "maxcdn.com",
    # build and quality services
    "circleci.com", "travis-ci.org", "travis-ci.com",
    "sonarcloud.io", "sonarqube.org", "sonar.io",
    "codecov.io", "coveralls.io", "codeclimate.com",
    "shields.io", "img.shields.io", "badge.fury.io",
    "sentry.io", "datadog.com", "newrelic.com",
    # tools and libraries
    "eslint.org", "typescript-eslint.io", "prettier.io",
    "rollupjs.org", "webpack.js.org", "parceljs.org", "vitejs.dev", "esbuild.github.io",
    "babeljs.io", "swc.rs", "terser.org",
    "jestjs.io", "mochajs.org", "jasmine.github.io", "karma-runner.github.io",
    "reactjs.org", "vuejs.org", "angular.io", "svelte.dev", "nextjs.org",
    "typescriptlang.org", "flow.org", "reasonml.github.io",
    "expressjs.com", "fastify.io", "nestjs.com", "koajs.com",
    "apache.org", "eclipse.org", "spring.io", "quarkus.io",
    "jetbrains.com", "intellij.com",
    # runtimes and systems
    "nodejs.org", "python.org", "ruby-lang.org", "java.com", "oracle.com",
    "rust-lang.org", "golang.org", "dotnet.microsoft.com",
    "ubuntu.com", "debian.org", "alpine-linux.org", "archlinux.org",
    "kernel.org", "gnu.org", "sourceforge.net",
    "brew.sh", "chocolatey.org", "scoop.sh",
    # documentation
    "docs.github.com", "developer.mozilla.org", "w3.org", "whatwg.org",
    "devdocs.io", "readthedocs.io", "readthedocs.org",
    # local
    "localhost", "127.0.0.1", "0.0.0.0",
]

TRUSTED_DOMAINS_STRICT = [
    # source hosting
    "github.com", "githubusercontent.com", "github.io", "raw.githubusercontent.com",
    "gitlab.com", "gitlab.io", "bitbucket.org", "azure.com", "dev.azure.com",
    "githubcopilot.com", "api.githubcopilot.com",
    # JavaScript packages
    "npmjs.org", "registry.npmjs.org", "npmjs.com", "yarnpkg.com",
    "registry.yarnpkg.com", "nodejs.org",
    # Python packages
    "pypi.org", "files.pythonhosted.org", "python.org", "pythonhosted.org",
    # JVM packages
    "maven.org", "mavencentral.org", "jfrog.io", "repo1.maven.org", "search.maven.org",
    "repo.maven.apache.org", "maven.apache.org", "central.sonatype.com",
    "repository.apache.org", "plugins.gradle.org", "gradle.org",
    # container registries
    "docker.io", "docker.com", "hub.docker.com", "gcr.io", "ghcr.io",
    "quay.io", "amazonaws.com", "ecr.aws", "azurecr.io", "mcr.microsoft.com",
    # clouds
    "googleapis.com", "storage.googleapis.com", "cloudflare.com",
    "microsoft.com", "windows.net", "azure.net", "vercel.app",
    "blob.core.windows.net",
    # content delivery
    "cloudfront.net", "akamaized.net", "unpkg.com", "cdnjs.cloudflare.com",
    "jsdelivr.net", "cdn.jsdelivr.net", "fastly.net",
    # other packages
    "nuget.org", "rubygems.org", "crates.io", "packagist.org",
    "pub.dev", "cocoapods.org", "go.dev", "pkg.go.dev", "proxy.golang.org",
    "rust-lang.org", "cran.r-project.org",
    # documentation and tools
    "eslint.org", "rollupjs.org", "babeljs.io", "webpack.js.org",
    "reactjs.org", "vuejs.org", "angular.io", "typescriptlang.org",
    "jestjs.io", "mochajs.org", "getbootstrap.com", "tailwindcss.com",
    "gnu.org", "docs.github.com",
]

TRUSTED_DOMAINS_GENERATED = [
    "github.com", "githubusercontent.com", "npmjs.org", "registry.npmjs.org",
    "pypi.org", "docker.io", "gcr.io", "amazonaws.com", "googleapis.com",
    "yarnpkg.com", "registry.yarnpkg.com", "maven.org", "gradle.org",
    "nuget.org", "rubygems.org", "crates.io", "nodejs.org", "python.org",
]

# --- fixed values: explanation thresholds (feature, high, very high, reason) -----------
FEATURE_THRESHOLDS = [
    ("duration_seconds", 600.0, 1800.0, "Unusually long build duration"),
    ("log_line_count", 8000.0, 15000.0, "Excessive log volume"),
    ("char_density", 150.0, 300.0, "Unusually dense log lines"),
    ("error_count", 200.0, 500.0, "High error count"),
    ("warning_count", 300.0, 600.0, "Excessive warnings"),
    ("step_count", 30.0, 50.0, "Unusual number of pipeline steps"),
    ("unique_templates", 600.0, 1000.0, "Unusual log pattern diversity"),
    ("template_entropy", 8.0, 10.0, "High log randomness (possible obfuscation)"),
    ("suspicious_pattern_count", 1.0, 5.0, "Suspicious command patterns detected"),
    ("external_ip_count", 1.0, 5.0, "Multiple external IP connections"),
    ("external_url_count", 10.0, 50.0, "Excessive untrusted URL access"),
    ("base64_pattern_count", 5.0, 15.0, "Potential data obfuscation"),
]

# --- fixed values: model configuration ---------------------------------------------------
N_ESTIMATORS = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.05
RANDOM_STATE = 42
MODEL_VERSION = "1.0.0"
LOF_NEIGHBORS = 20
CONTAMINATION_SWEEP = [0.01, 0.03, 0.05, 0.07, 0.10, 0.15, 0.20]
ESTIMATOR_SWEEP = [10, 25, 50, 100, 150, 200, 300]

# White space as str.strip() and str.isspace() see it.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The same set inside a character class; valid in Java and in RE2.
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
