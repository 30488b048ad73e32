"""Source languages: extensions, conventions, markers of side effects."""

from __future__ import annotations

from dataclasses import dataclass

# Extensions, default lens parameters and markers (kind, label, pattern), as lenses and questions expect them.
EXTENSIONS = {".java": "java", ".go": "go", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".ts": "js", ".tsx": "js"}
OTHER_SOURCES = (".kt", ".scala", ".py")
EXCLUDED_DIRS = (".git", ".gocache", ".gomodcache", ".projections", "node_modules", "target", "build", "dist", "vendor", "__MACOSX")
ORDER = ("java", "go", "js")
JAVA_MARKERS = (
    ("db", "jdbc/jpa", r"\b(\.save|\.saveAll|\.delete|\.persist|\.merge|createQuery|prepareStatement|executeQuery|executeUpdate|\.find(One|All|ById)?)\s*\("),
    ("network", "http-client", r"\b(RestTemplate|WebClient|HttpClient|\.getForObject|\.postForObject|\.exchange|URLConnection|new\s+URL)\b"),
    ("io-write", "file-write", r"\b(Files\.write|FileOutputStream|FileWriter|BufferedWriter|\.write|PrintWriter)\b"),
    ("io-read", "file-read", r"\b(Files\.read|FileInputStream|FileReader|BufferedReader|\.readAllBytes|Files\.lines)\b"),
    ("network", "messaging", r"\b(kafkaTemplate|\.send|\.publish|\.convertAndSend)\s*\("),
    ("process", "process/env", r"\b(ProcessBuilder|Runtime\.getRuntime|System\.getenv|System\.exit)\b"),
)
GO_MARKERS = (
    ("db", "database/sql", r"\b(db|tx|conn|pool|q|querier)\.(Query|QueryRow|Exec|QueryContext|ExecContext|QueryRowContext|Prepare|Begin|SendBatch|CopyFrom)\s*\(|\.(Save|Create|Updates?|Delete|First|Find|Where)\s*\("),
    ("db", "codegen-query", r"\b(pggen|sqlc|queries|db)\.(New)?Quer(y|ier)\b|NewQuerier\s*\(|\.(Insert|Select|Update|Delete|Upsert)[A-Z]\w*\s*\("),
    ("network", "http-client", r"\b(http\.(Get|Post|Head|PostForm|Do)|\.RoundTrip|net\.Dial|grpc\.Dial|\.Invoke|serviceFetch|client\.Do)\s*\("),
    ("io-write", "file-write", r"\b(os\.(Create|WriteFile|OpenFile|Remove(All)?|Mkdir(All)?)|ioutil\.WriteFile|\.Write(String)?)\s*\("),
    ("io-read", "file-read", r"\b(os\.(Open|ReadFile|Stat|ReadDir)|ioutil\.ReadFile|os\.ReadDir)\s*\("),
    ("process", "process/env", r"\b(exec\.Command|os\.(Getenv|Setenv|Exit|Environ))\b"),
)
JS_MARKERS = (
    ("network", "fetch/http", r"\b(fetch|axios|got|ky|http\.request|https\.request|XMLHttpRequest|\.\$fetch)\s*\("),
    ("db", "db/orm", r"\b(\.query|\.execute|prisma\.|\.findMany|\.findFirst|\.findUnique|\.create|\.update|\.delete|\.upsert|knex\(|\.raw)\s*\(|\b(pool|client|db)\.(query|connect)\s*\("),
    ("io-write", "fs-write", r"\b(fs\.(writeFile|writeFileSync|appendFile|rm|rmSync|unlink|mkdir|mkdirSync)|writeFile|createWriteStream)\s*\("),
    ("io-read", "fs-read", r"\b(fs\.(readFile|readFileSync|readdir|stat|existsSync)|createReadStream)\s*\("),
    ("process", "process/env", r"\b(process\.env|process\.exit|child_process|execSync|spawn|Bun\.spawn)\b"),
)
# Annotations of entry methods, base types of repositories, verbs of their methods, words that are no calls, test paths.
SPRING_ENTRY = r"@(RestController|Controller|(?:Get|Post|Put|Delete|Patch|Request)Mapping|KafkaListener|Scheduled|EventListener|MessageMapping|RabbitListener|SqsListener)\b"
REPOSITORY_BASES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository", "ListCrudRepository", "ReactiveCrudRepository", "Repository", "MongoRepository", "JpaSpecificationExecutor")
WRITE_VERBS = r"\b(save|saveAll|saveAndFlush|delete|deleteAll|deleteById|persist|merge|insert|update|upsert)\w*"
READ_VERBS = r"\b(find|get|read|query|exists|count|stream|search)\w*"
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "synchronized", "func", "function", "super", "this", "new", "typeof", "await", "yield", "throw", "go", "defer", "range")
TEST_PATH = r"(^|/)test/|_test\.|\.test\.|\.spec\."


@dataclass(frozen=True)
class Language:
    id: str
    markers: tuple
    entrypoints: str
    sinks: str


# What the entrypoints and exitpoints lenses look for by default.
LANGUAGES = {
    "java": Language("java", JAVA_MARKERS, "kafka-listener=@KafkaListener;scheduled=@Scheduled;event-listener=@EventListener;http-mapping=@(Get|Post|Put|Delete|Patch|Request)Mapping", "*repository*.save,*kafka*.send,*.publish"),
    "go": Language("go", GO_MARKERS, r"http-handler=func .*http\.ResponseWriter;route=\.(GET|POST|PUT|DELETE|HandleFunc)\(", "*repo*.Save,*.Exec,*.Publish"),
    "js": Language("js", JS_MARKERS, r"route=\.(get|post|put|delete)\(;listener=addEventListener\(;handler=\.on\(", "*repository*.save,*kafka*.send,*.publish"),
}


def language_of(path: str) -> str | None:
    return EXTENSIONS.get("." + path.rpartition("/")[2].rpartition(".")[2].lower()) if "." in path else None
