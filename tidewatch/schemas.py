"""Declared schemas of the records the jobs read and write, as DDL text."""

MATCH = "struct<id:string,name:string,score:double>"

ARTICLE = (
    "title string, content string, date date, source string"
)
NEWS = (
    f"title string, content string, date string, source string, summary string, mitre_match {MATCH}"
)
URL_ROW = (
    "html_file string, `group` string, url string, domain string, ip_address string"
)
SEED = (
    "`group` string, fqdn string")
LEAK_POST = (
    "date date, title string, `group` string")
GROUP_FEED = (
    "name string, locations array<struct<fqdn:string,enabled:boolean,updated:timestamp>>"
)
TECHNIQUE = (
    "technique_id string, technique_name string, description string"
)
GAZETTEER = (
    "region_code string, country_code string, latitude double, longitude double"
)
DNS = (
    "domain string, seq int, answer string, failure string")
FETCH_LOG = (
    "fqdn string, page int, ok boolean")

# Fields of a CVE detail document that the CVE table keeps (fixed values).
CVE_DETAIL = (
    "cve_id string, summary string, cvss double, cvss_v2 double, cvss_v3 double, "
    "epss double, ranking_epss double, kev boolean, ransomware_campaign string, "
    "propose_action string, cpes array<string>, published_time string"
)

# Feature columns that enrichment adds to a host row (fixed values).
HOST_FEATURES = (
    "product version cpe cpe23 components ssh_key ssh_kex ssh_mac ssh_cipher "
    "ssl_ja3s ssl_jarm ssl_fingerprint hostnames domains vulns tags server asn "
    "org isp country_code region_code ssl_issuer ssl_subject"
).split()

# What the lookup of a domain can report instead of an address (fixed values).
IP_STATUS = (
    "INVALID_DOMAIN NO_IP_FOUND DIG_ERROR_OR_NO_DOMAIN DIG_TIMEOUT DIG_UNEXPECTED_ERROR"
).split()
