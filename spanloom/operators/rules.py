"""The rules of detection: an ordered catalogue of patterns of public formats.

Order settles conflicts: a span of an earlier rule keeps its characters. A rule may ask for words before its value:
those words in any case, then what links them to a value. A link is an assignment mark or at most two linking words, so that prose such as
"a swift response" or "passport control" has no value; where the shape of a value is loose, it must also hold a digit. Only the words ignore
case, never the value. Quantifiers are bounded, so scanning is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from re import _constants, _parser


def required(pattern: str) -> frozenset[str]:
    """Lower-case strings of which every match of a pattern holds at least one, as long ones as can be told; the empty set where none can be."""

    def of(items) -> set[str]:
        best: set[str] = set()
        run = ""

        def better(found: set[str]) -> None:
            nonlocal best
            if found and all(found) and (not best or min(map(len, found)) > min(map(len, best))):
                best = found

        for op, args in items:
            if op is _constants.LITERAL:
                run += chr(args).lower()
                continue
            better({run} if run else set())
            run = ""
            if op is _constants.BRANCH:
                each = [of(x) for x in args[1]]
                better(set().union(*each) if all(each) else set())
            elif op is _constants.SUBPATTERN:
                better(of(args[-1]))
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and args[0] > 0:
                better(of(args[2]))
        better({run} if run else set())
        return best

    return frozenset(of(_parser.parse(re.sub(r"\\p\{\w+\}", ".", pattern))))


@dataclass(frozen=True)
class Rule:
    """type folds to category; check names one of functions.checks; probe is a cheap test of the text before the pattern runs.

    pattern is the value's alone and has no groups; before, if any, is what stands ahead of it; bounded values don't touch other word characters.
    """

    type: str
    category: str
    pattern: str
    check: str | None = None
    probe: str | None = None
    before: str = ""
    bounded: bool = False

    @cached_property
    def literals(self) -> frozenset[str]:
        """Strings of which a lower-cased text that the rule matches holds one."""
        found = required(self.before + self.pattern)
        return found if found and min(map(len, found)) > 1 or found == {"@"} else frozenset()

    @cached_property
    def digits(self) -> int:
        """How many digits a value has at least, with at most one other character between them: 6, 1 or 0."""
        return next((n for n in (6, 1) if _holds(self.pattern, n)), 0)

    @cached_property
    def run(self) -> int:
        """How many letters, digits, dashes and underscores (ASCII) a match has in a row at least."""
        return max(_in_a_row(self.before), _in_a_row(self.pattern))

    @cached_property
    def branches(self) -> tuple[tuple[frozenset[str], int], ...]:
        """The strings and the run of each alternative of a pattern that is nothing but alternatives without groups; none of any other."""
        inner = self.pattern[3:-1]
        if not (self.pattern.startswith("(?:") and self.pattern.endswith(")")) or re.search(r"[()\\]|\[[^\]]*\|", inner):
            return ()
        return tuple((required(x), _in_a_row(x)) for x in inner.split("|"))

    @property
    def regex(self) -> str:
        """With the value as the second group, behind that of what comes before it."""
        if self.before:
            return f"({self.before})({self.pattern})(?![A-Za-z0-9_])"
        return rf"()(?<![A-Za-z0-9_])({self.pattern})(?![A-Za-z0-9_])" if self.bounded else f"()({self.pattern})"


def _in_a_row(pattern: str) -> int:
    """The least length of the longest run of ASCII letters, digits, dashes and underscores in a match, as far as the pattern tells."""

    def plain(op, args) -> bool:
        if op is _constants.LITERAL:
            return args < 128 and (chr(args).isalnum() or chr(args) in "-_")
        if op is _constants.RANGE:
            return args[1] < 128 and all(chr(c).isalnum() or chr(c) in "-_" for c in range(args[0], args[1] + 1))
        return op is _constants.CATEGORY and args in (_constants.CATEGORY_WORD, _constants.CATEGORY_DIGIT)

    def of(items) -> tuple[int, int, bool]:
        """The longest run, the least length, and whether all of it is one run."""
        best, row, size, pure = 0, 0, 0, True
        for op, args in items:
            if op in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
                continue
            inside, n, one = 0, 1, False
            if op is _constants.IN:
                one = all(plain(*a) for a in args)
            elif op is _constants.LITERAL:
                one = plain(op, args)
            elif op is _constants.SUBPATTERN:
                inside, n, one = of(args[-1])
            elif op is _constants.BRANCH:
                each = [of(x) for x in args[1]]
                inside, n, one = min(x[0] for x in each), min(x[1] for x in each), all(x[2] for x in each)
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
                inside, n, one = of(args[2])
                inside, n = (inside if args[0] else 0), n * args[0]
            row, pure = (row + n, pure) if one else (0, False)
            size += n
            best = max(best, row, inside)
        return best, size, pure

    return of(_parser.parse(re.sub(r"\\p\{\w+\}", ".", pattern)))[0]


def _holds(pattern: str, n: int) -> bool:
    """Whether any match has n digits with at most one character between neighbours, as far as the pattern's groups tell."""

    def runs(items) -> list[int]:
        """Least digits in a row, parted by runs of other characters: -1 ends a row."""
        out: list[int] = []
        for op, args in items:
            if op is _constants.IN and args and all(a[0] is _constants.RANGE and a[1][0] >= 48 and a[1][1] <= 57 for a in args):
                out.append(1)
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
                low, high, inner = args
                each = runs(inner)
                if high == 1 and low == 0:
                    out.append(0 if -1 not in each and sum(each) == 0 and len(inner) <= 1 else -1)
                elif each == [1]:
                    out.append(low)
                elif low and sum(x for x in each if x > 0) and -1 not in each:
                    out.append(low * sum(each))
                else:
                    out.append(-1)
            elif op is _constants.SUBPATTERN:
                out += runs(args[-1])
            elif op is _constants.BRANCH:
                each = [max(_rows(runs(x))) for x in args[1]]
                out += [-1, min(each), -1]
            elif op in (_constants.LITERAL, _constants.IN, _constants.NOT_LITERAL, _constants.ANY):
                out.append(0)
            elif op not in (_constants.ASSERT, _constants.ASSERT_NOT, _constants.AT):
                out.append(-1)
        return out

    def _rows(found: list[int]) -> list[int]:
        rows, zeros = [0], 0
        for x in found:
            zeros = zeros + 1 if x == 0 else 0
            if x < 0 or zeros > 1:
                rows.append(0)
            rows[-1] += max(x, 0)
        return rows

    return max(_rows(runs(_parser.parse(re.sub(r"\\p\{\w+\}", ".", pattern))))) >= n


#: Between words and a value: a mark of assignment, or linking words, or no more than blanks.
_MARK = r"\s{0,3}[:=#°]\s{0,3}[\"']?"
_LINK = rf"(?:{_MARK}|(?:\s{{1,3}}(?i:is|est|ist|es|war|was|no|nr|n°|num|number|nummer|numéro|numero|número|code|id)\.?){{0,2}}(?:{_MARK}|\s{{1,3}}))"
#: A value of at most that many characters that holds a digit.
_WITH_DIGIT = r"(?=[^\s]{0,40}[0-9])"


def _words(words: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_])(?i:{words})"


def _after(kind: str, category: str, words: str, pattern: str, check: str | None = None, probe: str | None = None, link: str = _LINK) -> Rule:
    """A value that follows some words."""
    return Rule(kind, category, pattern, check, f"(?i){probe or words}", _words(words) + link)


def _bounded(kind: str, category: str, pattern: str, check: str | None = None, probe: str | None = None) -> Rule:
    """A value that stands for itself."""
    return Rule(kind, category, pattern, check, probe, bounded=True)


@dataclass(frozen=True)
class Vendor:
    """A vendor's own mark for a credential: where it is documented, what it begins with and what follows."""

    name: str
    documented: str
    begin: str
    rest: str
    type: str = "api_key"


_URLSAFE = "[A-Za-z0-9_-]"
_ALNUM = "[A-Za-z0-9]"
_HEX = "[0-9a-f]"

#: Fixed values, by vendor. Beginnings and lengths as the vendors' documents give them; where they give none, a wide range.
VENDORS = [
    Vendor("1Password", "service accounts", "ops_", "eyJ[A-Za-z0-9+/=_-]{100,1500}"),
    Vendor("age", "file encryption format, secret keys", "AGE-SECRET-KEY-1", "[0-9A-Z]{58}"),
    Vendor("Airtable", "personal access tokens", "pat", rf"{_ALNUM}{{14}}\.{_HEX}{{64}}"),
    Vendor("Amazon Web Services", "IAM identifiers, access key ids", "(?:AKIA|ASIA)", "[A-Z0-9]{16}", "aws_key"),
    Vendor("Atlassian", "API tokens", "ATATT3", "[A-Za-z0-9_=-]{100,250}"),
    Vendor("Brevo", "API keys", "xkeysib-", rf"{_HEX}{{64}}-{_ALNUM}{{16}}"),
    Vendor("Databricks", "personal access tokens", "dapi", f"{_HEX}{{32}}"),
    Vendor("DigitalOcean", "API tokens", "do[opr]_v1_", f"{_HEX}{{64}}"),
    Vendor("Docker", "personal access tokens", "dckr_pat_", f"{_URLSAFE}{{27}}"),
    Vendor("Doppler", "token formats", r"dp\.[a-z]{2,5}\.", f"{_ALNUM}{{40,64}}"),
    Vendor("Dynatrace", "token format", r"dt0[a-z]\d\d\.", r"[A-Z2-7]{24}\.[A-Z2-7]{64}"),
    Vendor("Figma", "personal access tokens", "figd_", f"{_URLSAFE}{{40,64}}"),
    Vendor("GitHub", "token formats", "gh[opsur]_", f"{_ALNUM}{{36,255}}", "github_token"),
    Vendor("GitHub", "fine-grained tokens", "github_pat_", r"\w{22,255}", "github_token"),
    Vendor("GitLab", "token prefixes", "gl(?:pat|dt|rt|ft|soat)-", f"{_URLSAFE}{{20,64}}"),
    Vendor("Google", "API keys", "AIza", f"{_URLSAFE}{{35}}", "google_key"),
    Vendor("Google", "OAuth access tokens", r"ya29\.", f"{_URLSAFE}{{20,500}}"),
    Vendor("Google", "OAuth client secrets", "GOCSPX-", f"{_URLSAFE}{{28}}"),
    Vendor("Grafana", "service account tokens", "glsa_", f"{_ALNUM}{{32}}_{_HEX}{{8}}"),
    Vendor("HashiCorp", "Vault service tokens", r"hvs\.", f"{_URLSAFE}{{24,200}}"),
    Vendor("Heroku", "API keys", "HRKU-", f"{_URLSAFE}{{36,64}}"),
    Vendor("Hugging Face", "user access tokens", "hf_", f"{_ALNUM}{{30,50}}"),
    Vendor("Linear", "API keys", "lin_api_", f"{_ALNUM}{{32,64}}"),
    Vendor("Mailgun", "API keys", "key-", f"{_HEX}{{32}}"),
    Vendor("Meta", "access tokens", "EAA", f"{_ALNUM}{{60,300}}"),
    Vendor("Netlify", "personal access tokens", "nfp_", f"{_ALNUM}{{36,64}}"),
    Vendor("New Relic", "user keys", "NRAK-", "[0-9A-Z]{27}"),
    Vendor("Notion", "integration tokens", "(?:ntn|secret)_", f"{_ALNUM}{{40,64}}"),
    Vendor("npm", "access tokens", "npm_", f"{_ALNUM}{{36}}"),
    Vendor("OpenAI and compatible", "API keys", "sk-", f"{_URLSAFE}{{20,250}}"),
    Vendor("PlanetScale", "tokens", "pscale_[a-z]{2,6}_", r"[\w.-]{32,64}"),
    Vendor("Postman", "API keys", "PMAK-", f"{_HEX}{{24}}-{_HEX}{{34}}"),
    Vendor("PyPI", "API tokens", "pypi-", f"{_URLSAFE}{{50,300}}"),
    Vendor("RubyGems", "API keys", "rubygems_", f"{_HEX}{{48}}"),
    Vendor("SendGrid", "API keys", r"SG\.", rf"{_URLSAFE}{{22}}\.{_URLSAFE}{{43}}"),
    Vendor("Sentry", "organisation tokens", "sntrys_", "[A-Za-z0-9+/=_-]{40,300}"),
    Vendor("Shopify", "access tokens", "shp[a-z]{2}_", "[0-9A-Fa-f]{32}"),
    Vendor("Slack", "token types", "xox[a-z]-", "[A-Za-z0-9-]{10,250}", "slack_token"),
    Vendor("Slack", "app-level tokens", "xapp-", "[A-Za-z0-9-]{10,250}", "slack_token"),
    Vendor("Square", "access tokens and secrets", "sq0[a-z]{3}-", f"{_URLSAFE}{{22,43}}"),
    Vendor("Stripe", "API keys", "[prs]k_(?:live|test)_", f"{_ALNUM}{{16,250}}"),
    Vendor("Stripe", "webhook signing secrets", "whsec_", f"{_ALNUM}{{20,80}}"),
    Vendor("Supabase", "access tokens", "sbp_", f"{_HEX}{{40}}"),
    Vendor("Telegram", "bot tokens", r"\d{8,10}:AA", f"{_URLSAFE}{{33}}"),
    Vendor("Twilio", "account and key SIDs", "(?:AC|SK)", f"{_HEX}{{32}}"),
]


def _vendors() -> list[Rule]:
    return [Rule(v.type, "secret", rf"(?<![A-Za-z0-9_])(?:{v.begin})(?:{v.rest})(?![A-Za-z0-9_])", probe=v.begin) for v in VENDORS]


_DATE = r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})"
#: What may part groups of digits.
_N = r"[ .\-]?"


def _groups(*sizes: int, by: str = _N) -> str:
    return by.join(f"[0-9]{{{n}}}" for n in sizes)


def _secrets() -> list[Rule]:
    named = r"(?:[A-Z0-9]{1,20}_){0,4}(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|mot de passe|passwort|contraseña|senha)"
    probe = "passw|pwd|secret|token|key|contrase|senha|mot de passe"
    return [
        Rule("private_key", "secret", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]{1,8000}?-----END [A-Z ]{0,30}PRIVATE KEY-----", probe="PRIVATE KEY"),
        Rule("jwt", "secret", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,4000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,1000}", probe="eyJ"),
        Rule("connection_string", "secret", r"(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|mssql|jdbc:[a-z]{2,12}|kafka|nats)://[^\s\"'<>]{3,500}", "not_placeholder", "://"),
        *_vendors(),
        _after("bearer", "secret", "bearer|authorization: basic", r"[A-Za-z0-9._~+/-]{16,2000}={0,2}", "mixed_token", "bearer|basic"),
        Rule("api_key", "secret", r"ssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/]{40,2000}={0,3}", probe="ssh-"),
        _after("cookie", "secret", "(?:set-)?cookie", r"[A-Za-z0-9_-]{1,60}=[^\s;]{8,500}(?:; ?[A-Za-z0-9_-]{1,60}=[^\s;]{1,500}){0,30}", "not_placeholder", "cookie", _MARK),
        _after("secret", "secret", "otp|one[- ]time code|(?:verification|pin|security) code|code de vérification|bestätigungscode|código de verificación", "[0-9]{4,8}", None, "otp|code|código"),
        # Behind a mark of assignment anything is a value; behind "is" it must hold a digit.
        _after("secret", "secret", named, r"[^\s\"',;]{6,200}", "not_placeholder", probe, _MARK),
        _after("secret", "secret", named, rf"{_WITH_DIGIT}[^\s\"',;.]{{6,200}}", "not_placeholder", probe, r"\s(?i:is|est|ist|es)\s\"?"),
        _bounded("uuid", "secret", "-".join(f"[0-9a-fA-F]{{{n}}}" for n in (8, 4, 4, 4, 12)), probe="[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"),
        _bounded("crypto", "secret", r"0x[0-9a-fA-F]{40}", probe="0x"),
        _bounded("crypto", "secret", r"(?:bc1[02-9ac-hj-np-z]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34})", "mixed_token", "bc1|[1-9A-HJ-NP-Za-km-z]{26}"),
    ]


def _numbers() -> list[Rule]:
    """Numbers of people, companies, accounts and devices; those without a check digit of their own need words before them."""
    person, company = "national_id", "company_id"
    return [
        _after("device_id", person, "imei", rf"{_groups(2, 6, 6, 1)}", "imei"),
        _after("device_id", person, "vin|chassis|fahrgestell\\w{0,10}", r"[A-HJ-NPR-Z0-9]{17}", "vin"),
        _after("device_id", person, "iccid|sim", r"89[0-9]{17,18}", "iccid"),
        _bounded("passport_mrz", person, r"[A-Z0-9<]{9}[0-9][A-Z<]{3}[0-9]{7}[MFX<][0-9]{7}[A-Z0-9<]{15}[0-9]", "mrz", "<<"),
        _bounded(company, company, r"[A-Z0-9]{18}[0-9]{2}", "lei", "[A-Z0-9]{18}"),
        _bounded(company, company, _groups(3, 3, 3, 5), "siret", "[0-9]{5}"),
        _bounded("iban", "iban", r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{1,4}){3,8}", "iban", "[A-Za-z]{2}[0-9]{2} ?[A-Za-z0-9]{4}"),
        _bounded("card", "card", r"[0-9](?:[ -]?[0-9]){12,18}", "card", "[0-9][0-9 -]{12}"),
        _after("account", "iban", "rib|compte", r"[0-9]{5} ?[0-9]{5} ?[0-9A-Z]{11} ?[0-9]{2}", "rib"),
        _after("account", "iban", "clabe", "[0-9]{18}", "mx_clabe"),
        _bounded("isin", company, r"[A-Z]{2}[A-Z0-9]{9}[0-9]", "isin", "[A-Z]{2}[A-Z0-9]{9}[0-9]"),
        _after(person, person, "ssn|social security", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn"),
        _after(person, person, "npi", "[12][0-9]{9}", "npi"),
        _after(person, person, "dea", "[A-Z][A-Z9][0-9]{7}", "dea"),
        _after(company, company, "ein|employer identification", r"[0-9]{2}-[0-9]{7}"),
        _bounded(person, person, r"[1278] ?[0-9]{2} ?[0-9]{2} ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}", "nir", "[0-9]{2} ?(?:[0-9]|2[AB])"),
        _bounded(company, company, r"FR ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}", "fr_vat", "FR ?[0-9]"),
        _bounded(company, company, r"BE ?[01][0-9]{3}[ .]?[0-9]{3}[ .]?[0-9]{3}", "be_vat", "BE ?[01]"),
        _bounded(company, company, r"IT ?[0-9]{11}", "it_vat", "IT ?[0-9]"),
        _bounded(company, company, r"SE ?[0-9]{12}", "se_vat", "SE ?[0-9]"),
        _bounded(company, company, r"DK ?[0-9]{8}", "dk_cvr", "DK ?[0-9]"),
        _bounded(company, company, r"PL ?[0-9]{10}", "pl_nip", "PL ?[0-9]"),
        _bounded(company, company, r"(?:ATU[0-9]{8}|DE[0-9]{9}|ES[A-Z0-9][0-9]{7}[A-Z0-9]|NL[0-9]{9}B[0-9]{2}|PT[0-9]{9}|FI[0-9]{8}|GB[0-9]{9})", None, "ATU|DE[0-9]|ES[A-Z0-9][0-9]|NL[0-9]|PT[0-9]|FI[0-9]|GB[0-9]"),
        _after(company, company, "siren|rcs", _groups(3, 3, 3, by=" ?"), "siren"),
        _after(company, company, "partita iva|p\\. ?iva", "[0-9]{11}", "it_vat"),
        _after(company, company, "nip", r"[0-9]{3}-?[0-9]{3}-?[0-9]{2}-?[0-9]{2}", "pl_nip"),
        _after(company, company, "regon", "[0-9]{9}", "pl_regon"),
        _after(company, company, "cvr", "[0-9]{8}", "dk_cvr"),
        _after(company, company, "org(?:anisasjons)?\\.? ?(?:nr|nummer)", "[0-9]{3} ?[0-9]{3} ?[0-9]{3}", "no_orgnr", "org"),
        _after(company, company, "y-tunnus|business id", "[0-9]{7}-[0-9]", "fi_ytunnus"),
        _after(company, company, "统一社会信用代码|uscc|unified social credit", "[0-9A-HJ-NPQRTUWXY]{18}", "cn_uscc"),
        _bounded(person, person, r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]", None, "[A-Z]{2} ?[0-9]{2}"),
        _after(person, person, "nhs", _groups(3, 3, 4, by=" ?"), "nhs"),
        _after(person, person, "steuer-?id|idnr|steueridentifikationsnummer|tin", _groups(2, 3, 3, 3, by=" ?"), "steuer_id"),
        _after(person, person, "rentenversicherung\\w{0,12}|rvnr|sozialversicherungsnummer", r"[0-9]{2} ?[0-9]{6} ?[A-Z] ?[0-9]{3}", "de_rvnr"),
        _after(person, person, "svnr|sv-nummer|sozialversicherungsnummer", "[0-9]{4} ?[0-9]{6}", "at_svnr"),
        _bounded(person, person, r"(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z]", "dni", "[0-9]{7}-?[A-Z]"),
        _bounded(person, person, r"[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]", "it_codice_fiscale", "[A-Z]{6}[0-9]{2}"),
        _after(person, person, "nif|contribuinte", "[0-9]{9}", "pt_nif"),
        _after(person, person, "bsn|burgerservicenummer|sofinummer", "[0-9]{9}", "bsn"),
        _bounded(person, person, r"[0-9]{2}\.[0-9]{2}\.[0-9]{2}-[0-9]{3}\.[0-9]{2}", "be_nrn", r"[0-9]-[0-9]{3}\.[0-9]"),
        _after(person, person, "pesel", "[0-9]{11}", "pesel"),
        _after(person, person, "personnummer|personal identity number", r"(?:19|20)?[0-9]{6}[-+][0-9]{4}", "se_personnummer"),
        _after(person, person, "fødselsnummer|fnr|fodselsnummer", "[0-9]{6} ?[0-9]{5}", "no_fnr"),
        _after(person, person, "cpr(?:-nummer|-nr)?", r"[0-9]{6}-[0-9]{4}", None, "cpr"),
        _bounded(person, person, r"[0-9]{6}[-+A-F][0-9]{3}[0-9A-Y]", "fi_hetu", "[0-9]{6}[-+A-F][0-9]{3}"),
        _bounded(person, person, r"756\.[0-9]{4}\.[0-9]{4}\.[0-9]{2}", "ch_ahv", r"756\."),
        _after(person, person, "cnp", "[1-8][0-9]{12}", "ro_cnp"),
        _after(person, person, "egn|егн", "[0-9]{10}", "bg_egn"),
        _after(person, person, "kennitala|kt", r"[0-9]{6}-?[0-9]{4}", "is_kennitala"),
        _after(person, person, "isikukood|asmens kodas", "[1-6][0-9]{10}", "ee_isikukood"),
        _after(person, person, "oib", "[0-9]{11}", "hr_oib"),
        _after(person, person, "jmbg|emšo|emso", "[0-9]{13}", "rs_jmbg"),
        _after(person, person, "rodné číslo|rodne cislo|rč", "[0-9]{6}/?[0-9]{4}", "cz_rc"),
        _after(person, person, "amka|αμκα", "[0-9]{11}", "gr_amka"),
        _after(person, person, "matricule", "[0-9]{13}", "lu_matricule"),
        _after(person, person, "pps(?:n| number)?", "[0-9]{7}[A-W][A-IW]?", "ie_pps", "pps"),
        _after(person, person, "tckn|t\\.?c\\.? kimlik", "[1-9][0-9]{10}", "tr_tckn", "tckn|kimlik"),
        _bounded(person, person, r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", "cpf", r"[0-9]{3}\.[0-9]{3}-[0-9]{2}"),
        _bounded(company, company, r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}", "cnpj", "/[0-9]{4}-"),
        _after(person, person, "pis|pasep|nit", r"[0-9]{3}\.?[0-9]{5}\.?[0-9]{2}-?[0-9]", "br_pis"),
        _bounded(company, company, r"[0-9]{2}-[0-9]{8}-[0-9]", "cuit", "-[0-9]{8}-"),
        _bounded(person, person, r"[0-9]{1,2}\.[0-9]{3}\.[0-9]{3}-[0-9Kk]", "rut", r"\.[0-9]{3}-[0-9Kk]"),
        _bounded(person, person, r"[A-Z][AEIOUX][A-Z]{2}[0-9]{6}[HMX][A-Z]{5}[A-Z0-9][0-9]", "mx_curp", "[A-Z]{4}[0-9]{6}[HMX]"),
        _after(company, company, "nit", r"[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]", "co_nit"),
        _after(person, person, "cédula|cedula", "[0-9]{10}", "ec_cedula"),
        _after(company, company, "ruc", "[0-9]{11}", "pe_ruc"),
        _after(person, person, "c\\.?i\\.?|cédula", r"[0-9]\.?[0-9]{3}\.?[0-9]{3}-?[0-9]", "uy_ci", "ci|c\\.i|cédula"),
        _after(person, person, "aadhaar|uidai", _groups(4, 4, 4, by=" ?"), "aadhaar"),
        _after(person, person, "pan|permanent account", r"[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]"),
        _bounded(company, company, r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]", None, "[A-Z]{5}[0-9]{4}[A-Z]"),
        _bounded(person, person, r"[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])[0-3][0-9][0-9]{3}[0-9Xx]", "resident_cn", "[0-9]{17}"),
        _after(person, person, "hkid|身份證號碼|identity card", r"[A-Z]{1,2}[0-9]{6}\(?[0-9A]\)?", "hk_id"),
        _after(person, person, "my ?number|マイナンバー|個人番号", _groups(4, 4, 4, by="[ -]?"), "jp_my_number"),
        _after(person, person, "rrn|주민등록번호", r"[0-9]{6}-?[1-8][0-9]{6}", "kr_rrn"),
        _after(person, person, "เลขประจำตัวประชาชน|thai id|national id", r"[0-9]-?[0-9]{4}-?[0-9]{5}-?[0-9]{2}-?[0-9]", "th_id"),
        _bounded(person, person, r"[STFG][0-9]{7}[A-Z]", "nric", "[STFG][0-9]{7}[A-Z]"),
        _after(person, person, "tfn|tax file", _groups(3, 3, 3, by=" ?"), "tfn"),
        _after(person, person, "medicare", "[2-6][0-9]{3} ?[0-9]{5} ?[0-9](?: ?[0-9])?", "au_medicare"),
        _after(company, company, "abn", _groups(2, 3, 3, 3, by=" ?"), "abn"),
        _after(company, company, "acn", _groups(3, 3, 3, by=" ?"), "au_acn"),
        _after(person, person, "ird", r"[0-9]{2,3}-?[0-9]{3}-?[0-9]{3}", "nz_ird"),
        _after(person, person, "sin|social insurance", _groups(3, 3, 3, by="[ -]?"), "sin"),
        _after(person, person, "id number|identity number|rsa id", "[0-9]{13}", "za_id", "id"),
        _after(person, person, "teudat zehut|תעודת זהות", "[0-9]{9}", "il_id"),
        _after(person, person, "passport|passeport|reisepass|pasaporte|passaporto", rf"{_WITH_DIGIT}[A-Z0-9]{{6,9}}"),
        _after("licence", person, "driving licen[cs]e|driver'?s licen[cs]e|permis de conduire|führerschein(?:nummer)?|carnet de conducir|patente", rf"{_WITH_DIGIT}[A-Z0-9][A-Z0-9 -]{{5,16}}[A-Z0-9]"),
        _after("health_id", person, "insurance (?:no|number)|versichertennummer|numéro d'assuré|medical record|mrn|patient id|dossier", rf"{_WITH_DIGIT}[A-Z0-9][A-Z0-9-]{{4,16}}"),
        _after("reference", "reference", "(?:invoice|order|contract|policy|claim|case|ticket|customer|account) (?:no|nr|number|id)|facture n°|commande n°|contrat n°|rechnungsnummer|vertragsnummer|kundennummer|número de (?:pedido|factura)", rf"{_WITH_DIGIT}[A-Z0-9][A-Z0-9/-]{{3,20}}", None, "no|nr|number|id|n°|nummer|número"),
        _after("book", "reference", "isbn", r"(?:97[89][- ]?)?[0-9](?:[- ]?[0-9]){8}[- ]?[0-9X]"),
        _after("bic", "iban", "bic|swift", r"[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"),
        _after("routing", "iban", "routing|aba", "[0-9]{9}", "aba"),
        _after("plate", "vehicle", "licen[cs]e plate|plaque|immatriculation|kennzeichen|matrícula|targa", r"[A-Z]{1,3}[ -]?(?:[0-9]{1,4}[ -]?[A-Z]{1,3}|[A-Z]{1,2}[ -]?[0-9]{1,4})"),
    ]


def _contacts() -> list[Rule]:
    return [
        _bounded("geo", "location", r"-?[0-9]{1,2}\.[0-9]{4,8}\s{0,2},\s{0,2}-?[0-9]{1,3}\.[0-9]{4,8}", "lat_long", r"\.[0-9]{4,8}\s{0,2},"),
        _after("dob", "dob", "(?:date of birth|birth ?date|dob|geburtsdatum|date de naissance|fecha de nacimiento|data di nascita)", _DATE, "real_date", "birth|dob|geburt|naissance|nacimiento|nascita"),
        _after("dob", "dob", "born|née?|geboren|nacid[oa]|nat[oa]|nascid[oa]", _DATE, "real_date", "born|n[ée]|nat[oa]|geboren|nacid|nascid", r"\s(?:(?i:on|le|am|el|il|em|the|den)\s){0,2}"),
        _bounded("phone", "phone", r"(?:\+|00)[1-9](?:[ .()-]{0,2}[0-9]){7,14}", "intl_phone", "[+][0-9]|00[1-9]"),
        Rule("phone", "phone", r"(?<![A-Za-z0-9_])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![A-Za-z0-9_])", "us_phone", "[0-9][ .-][0-9]{4}"),
        _bounded("phone", "phone", r"0[1-9](?:[ .-]?[0-9]{2}){4}", None, "0[1-9][ .-]?[0-9]{2}"),
        _after("phone", "phone", "tel|phone|téléphone|telefon|teléfono|telefono|mobile|fax|handy", r"[0-9(][0-9 ().-]{5,16}[0-9]", "intl_phone", "tel|phone|fax|mobile|handy|phon"),
        Rule("email", "email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", probe="@"),
        _bounded("mac", "ip", r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", None, "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
        _bounded("ip", "ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "ipv4", r"[0-9]\.[0-9]{1,3}\.[0-9]"),
        _bounded("ip", "ip", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?", None, "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
        _after("username", "username", "handle|username|user name|twitter|instagram|pseudo", r"@[A-Za-z0-9_]{2,30}", None, "@"),
        _after("username", "username", "my (?:handle|username|nick(?:name)?) is|mon pseudo est|mein benutzername ist|mi usuario es", r"[A-Za-z0-9_.-]{3,30}", None, "handle|username|nick|pseudo|benutzername|usuario", r"\s{1,2}[\"'@]?"),
    ]


def _prose() -> list[Rule]:
    """Names, addresses and organisations that stand beside something that marks them."""
    capital = r"\p{Lu}[\p{L}'’-]{1,30}"
    particles = r"(?:(?:de|del|della|van|von|der|den|di|la|le|du|dos|da|bin|al|el) ){0,2}"
    person = rf"{capital}(?: {particles}{capital}){{0,3}}"
    tail = rf"(?:,? [0-9]{{4,5}} {capital}(?:[ -]{capital}){{0,2}})?"
    titles = "mr|mrs|ms|mx|dr|prof|professor|madame|monsieur|mme|mlle|herr|frau|señora?|sra?|sig|signora?|dott|mevrouw|meneer|maître"
    labels = "(?:full |first |last |family |given )?name|nom|prénom|surname|vorname|nachname|nombre|apellidos?|nome|cognome|naam|achternaam|imię|nazwisko"
    return [
        _after("name", "name", titles, person, None, rf"(?<![a-z])(?:{titles})[. ]", r"\.?\s{1,3}"),
        _after("name", "name", labels, person, None, rf"(?:{labels})\s{{0,3}}[:=]", _MARK),
        Rule("address", "address", rf"(?<![0-9])[0-9]{{1,5}}(?: ?(?:bis|ter|[A-D]))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|rua|avenida)(?: [\p{{L}}'’.-]{{1,25}}){{1,6}}?(?:,? [0-9]{{5}} {capital}|(?=[,;\n.]|$))", probe=r"[0-9],? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|rua|avenida)|(?:bis|ter|[A-D]),? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|rua|avenida)"),
        Rule("address", "address", rf"(?<![0-9])[0-9]{{1,6}} (?:{capital} ){{1,4}}(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Square|Place)(?![\p{{L}}])", probe=r" (?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Square|Place)\b"),
        Rule("address", "address", rf"(?<![\p{{L}}])\p{{Lu}}[\p{{L}}.-]{{1,30}}(?:straße|strasse|str\.|weg|platz|allee|gasse|straat|laan|gracht) [0-9]{{1,4}}[a-z]?{tail}", probe=r"(?:straße|strasse|str\.|weg|platz|allee|gasse|straat|laan|gracht) [0-9]"),
        Rule("address", "address", rf"(?<![\p{{L}}])(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Corso)(?: [\p{{L}}'’.-]{{1,25}}){{1,5}},? [0-9]{{1,4}}{tail}", probe="Calle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Corso"),
        _after("postal", "address", "zip(?: code)?|postal code|postcode|code postal|plz|postleitzahl|código postal|cap", r"[0-9]{4,5}(?:-[0-9]{3,4})?|[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}", None, "zip|post|plz|cap"),
        Rule("company", "company", rf"(?<![\p{{L}}])(?:\p{{Lu}}[\p{{L}}0-9&'’-]{{1,30}} ){{1,4}}(?:Inc|LLC|Ltd|GmbH|AG|SARL|SAS|SpA|BV|NV|Oy|PLC|KG|Corp|SL)(?![\p{{L}}0-9])\.?", probe=r" (?:Inc|LLC|Ltd|GmbH|AG|SARL|SAS|SpA|BV|NV|Oy|PLC|KG|Corp|SL)\b"),
        _after("company", "company", "company|employer|société|entreprise|firma|arbeitgeber|empresa|azienda|ragione sociale|raison sociale", r"\p{Lu}[\p{L}0-9&'’. -]{1,40}[\p{L}0-9]", None, r"(?:company|employer|société|entreprise|firma|arbeitgeber|empresa|azienda|sociale)\s{0,3}[:=]", _MARK),
        _after("job", "job", "job title|occupation|profession|beruf|profesión|professione|poste", r"[\p{L}][\p{L}'’ -]{2,40}[\p{L}]", None, r"(?:title|occupation|profession|beruf|profesión|professione|poste)\s{0,3}[:=]", _MARK),
        _after("city", "location", "city|town|ville|stadt|ort|ciudad|città|cidade|plaats", rf"{capital}(?:[ -]{capital}){{0,2}}", None, r"(?:city|town|ville|stadt|ort|ciudad|città|cidade|plaats)\s{0,3}[:=]", _MARK),
        _after("country", "location", "country|pays|land|país|paese|nationality|nationalité|staatsangehörigkeit|nacionalidad", rf"{capital}(?:[ -]{capital}){{0,2}}", None, r"(?:country|pays|land|país|paese|national\w{2,4}|staatsangehörigkeit|nacionalidad)\s{0,3}[:=]", _MARK),
        _after("amount", "amount", "salary|salaire|gehalt|salario|stipendio|balance|solde|montant|amount due", r"[€$£] ?[0-9][0-9 .,']{0,14}[0-9]|[0-9][0-9 .,']{0,14}[0-9] ?(?:€|\$|£|EUR|USD|GBP|CHF)", None, "sala|gehalt|stipendio|balance|solde|montant|amount"),
    ]


def catalogue() -> list[Rule]:
    """All rules, in the order in which they claim their spans."""
    return [
        Rule("url", "url", r"(?:https?|ftp)://[^\s<>\"'`|]{1,2000}|(?<![A-Za-z0-9.])www\.[^\s<>\"'`|]{1,2000}", probe=r"://|www\."),
        Rule("path", "path", r"(?<![A-Za-z0-9_:/.<])/(?:home|Users|etc|var|opt|usr|mnt|srv|tmp)(?:/[A-Za-z0-9._+@-]{1,100}){1,20}", probe="/(?:home|Users|etc|var|opt|usr|mnt|srv|tmp)/"),
        Rule("path", "path", r"(?<![A-Za-z0-9_])[A-Za-z]:\\(?:[A-Za-z0-9._ $+@()-]{1,100}\\){0,20}[A-Za-z0-9._$+@()-]{1,100}", probe=r":\\"),
        *_secrets(),
        *_numbers(),
        *_contacts(),
        *_prose(),
        _bounded("hash_token", "apikey", r"[0-9a-f]{40}|[0-9a-f]{64}", None, "[0-9a-f]{40}"),
        _bounded("api_token", "apikey", r"[A-Za-z0-9_-]{20,200}", "mixed_token", "[A-Za-z0-9_-]{20}"),
    ]


#: A small set whose patterns mean the same to any regular-expression engine: for reports that SQL must reproduce.
PORTABLE = [
    Rule("email", "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", probe="@"),
    Rule("phone_us", "phone", r"\+1 \([2-9][0-9]{2}\) [0-9]{3}-[0-9]{4}", probe=r"\+1"),
    Rule("ipv4", "ip", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "ipv4", probe=r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    Rule("card_number", "card", r"[0-9](?:[ -]?[0-9]){12,18}", "card", probe="[0-9][0-9 -]{12}"),
    Rule("hex40", "secret", r"[0-9a-f]{40}", probe="[0-9a-f]{40}"),
]
