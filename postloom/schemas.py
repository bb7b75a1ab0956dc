"""Record shapes. ``seq`` is the arrival order: unique, assigned at landing, and larger in
every later batch than anything already stored."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TEXT, INT, LONG, FLAG, TEXTS = (
    StringType(), IntegerType(), LongType(), BooleanType(), ArrayType(StringType()),
)


def shape(names: str, **types: DataType) -> StructType:
    """Fields in order; every field is text unless given another type."""
    return StructType([StructField(n, types.get(n, TEXT)) for n in names.split()])


def with_seq(schema: StructType) -> StructType:
    return StructType([StructField("seq", LONG), *schema.fields])


POSTING = shape(
    "id source sourceType company title location remoteType employmentType department "
    "requisitionId postingDate discoveredAt lastSeenAt canonicalUrl applyUrl descriptionText "
    "descriptionHtml requiredYears salaryText matchedProfiles discoveredFrom discoveredUrl "
    "rawMetadata",
    requiredYears=INT, matchedProfiles=TEXTS, discoveredFrom=TEXTS,
)
LISTING = shape(
    "source searchKeyword title company location salarySnippet resultUrl possibleOfficialUrl "
    "postingAgeOrDate sourceJobId discoveredAt matchedProfiles",
    matchedProfiles=TEXTS,
)
STORED_POSTING = with_seq(POSTING)
STORED_LISTING = with_seq(LISTING)

RAW_PAYLOAD = shape(
    "seq site_id source_kind request_keyword page_no url status title body",
    seq=LONG, page_no=INT, status=INT,
)
RAW_PAGE = shape("seq source keyword location page_no url html", seq=LONG, page_no=INT)
SITE = shape(
    "seq id name url adapter enabled greenhouse lever workday generic",
    seq=LONG,
    enabled=FLAG,
    greenhouse=shape("boardToken"),
    lever=shape("site"),
    workday=shape("hostname tenant site"),
    generic=shape(
        "searchInputSelector searchButtonSelector resultCardSelector jobLinkSelector "
        "nextButtonSelector loadMoreSelector titleSelector locationSelector descriptionSelector "
        "applyLinkSelector companySelector salarySelector dateSelector searchUrlTemplate"
    ),
)
ROLE = shape("seq id profile keywords", seq=LONG, keywords=TEXTS)
REGISTRY = shape(
    "seq company fortuneRank corporateDomain careersUrl atsType atsTenantOrBoardId "
    "verificationStatus lastVerifiedDate",
    seq=LONG, fortuneRank=INT,
)
PROGRESS = shape(
    "key source keyword location lastPage completed lastUpdated", lastPage=INT, completed=FLAG
)
SEEN_IDS = shape("key source_job_id first_seq", first_seq=LONG)
DETAIL = shape(
    "externalId title descriptionText descriptionHtml location department employmentType "
    "requisitionId postingDate salaryText canonicalUrl applyUrl rawMetadata"
)

# The closed sets used by the records.
ATS_KINDS = ["greenhouse", "lever", "workday", "generic"]
PROFILES = ["sdet", "security", "cloud", "network"]
VERIFICATION_STATUSES = ["verified", "unverified", "blocked"]

# Default limits.
MAX_PAGES_PER_SOURCE = 100
MAX_JOBS_PER_SOURCE = 5000
