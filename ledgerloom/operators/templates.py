"""Registry of message templates. Order matters: the first template that matches a message is used.

Fixed values: names and patterns. They have to equal the ones in use for the same messages to be recognised.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser


@dataclass(frozen=True)
class Template:
    """Patterns of one kind of message.

    ``vendor`` is a pattern when it starts with ``(?`` or with ``Merchant``, otherwise the vendor itself.
    ``hints`` are lower-case texts of which one has to occur in a body before any pattern is tried.
    """

    name: str
    account: str
    amount: str
    vendor: str
    date: str = ""
    cells: bool = False
    date_optional: bool = False
    subject_pattern: str = ""
    subject_vendor: str = ""
    email_from: str = ""
    hints: tuple[str, ...] = ()

    @property
    def vendor_is_pattern(self) -> bool:
        return self.vendor.startswith(("(?", "(.*?)", "Merchant"))


def groups(pattern: str) -> int:
    """Number of capture groups."""
    return re.compile(re.sub(r"^\(\?s\)", "", pattern)).groups


def always_captures(pattern: str) -> bool:
    """True if each occurrence surely captures some text, so that an empty capture means that there is none.

    Sure is a piece that is always part of an occurrence: a group that cannot be empty, or alternatives that all have one.
    """

    def sure(pieces) -> bool:
        for kind, value in pieces:
            if kind is _parser.SUBPATTERN:
                if (value[0] and value[3].getwidth()[0] > 0) or sure(value[3]):
                    return True
            elif kind is _parser.BRANCH:
                if all(sure(branch) for branch in value[1]):
                    return True
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0 and sure(value[2]):
                return True
        return False

    parsed = _parser.parse(re.sub(r"^\(\?s\)", "", pattern))
    return sure(parsed) if groups(pattern) else parsed.getwidth()[0] > 0


# Fixed values.
TEMPLATES = [
    Template(
        name="Huntington Checking/Savings",
        account=r"(?<=CK)(\d{4})",
        amount=r"(?<=for\s\$)(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\b(?=(?:\s+(?:from|at)|$))",
        vendor=r"(?<= at )(.+?)(?= from)|(?<=from\s)(.+?)(?= to )",
        date=r"(?<=as of )(\d{1,2}\/\d{1,2}\/\d{2}\s+\d{1,2}:\d{2}\s+(?:AM|PM)\s+ET)",
        hints=("as of ",),
    ),
    Template(
        name="Target Credit Card",
        account=r"(?<=ending in )[\d]{4}",
        amount=r"(?<=transaction of \$)(\d{1,3}(?:,\d{3})*(?:\.\d+)?)(?= at)",
        vendor=r"(?s)(?<=\sat\s)(.*?)(?=\s+was|\s+has)",
        hints=("transaction of $",),
    ),
    Template(
        name="US Bank - Credit Card",
        account=r"(?<=card ending in )\d{4}",
        amount=r"\$(\d+(?:\.\d+)?)",
        vendor=r"(?<=at )([^.]+)",
        hints=("card ending in ",),
    ),
    Template(
        name="Chase Payment Sent",
        account=r"Account ending in[^(]*\(\.\.\.([\d]{4})\)",
        amount=r"You sent \$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?:You sent \$[\d,.]+\s+to\s+([^<\r\n\s]+)|Recipient<\/td>\s*<td[^>]*>\s*([^<\r\n\s]+))",
        date=r"Sent on<\/td>[\s\S]*?<td[^>]*>\s*(?:<[^>]+>\s*)*([^<]+(?:AM|PM)\sET)",
        subject_pattern=r"You sent \$[\d,.]+.*account ending in",
        hints=("you sent $",),
    ),
    Template(
        name="Capital One Credit Card",
        account=r"(?:ending in|card ending in|last 4 #)\s*(\d{4})",
        amount=r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?s),\s*at\s+([^,]+),",
        date=r"on\s+(\d{1,2}\/\d{1,2}\/\d{4})(?=,)",
        hints=("ending in", "last 4 #"),
    ),
    Template(
        name="Discover Credit Card",
        account=r"(?:Last 4 #:\s*[ ]*|Account ending in\s*)(\d{4})",
        amount=r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?:Merchant\s*:+\s*|at\s+)([^<\n\r]+?)(?=\s*(?:Amount:|\s*$|\s*,))",
        date=r"(?:Date:\s*|Transaction Date:\s*)([^<\n\r]+?)(?=(?:\s*<br\/>|\s*$))",
        hints=("last 4 #:", "account ending in"),
    ),
    Template(
        name="Discover Transaction Alert",
        account=r"Account ending in\s+(\d{4})",
        amount=r"Amount: \$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?s)Merchant:\s+([^\n]+)",
        date=r"Transaction Date::\s*([^\n]+)",
        hints=("transaction date::",),
    ),
    Template(
        name="Chase Direct Deposit",
        account=r"Account ending in[^(]*\(\.\.\.([\d]{4})\)",
        amount=r"You have a direct deposit of \$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"Direct Deposit",
        date=r">([^<]+(?:AM|PM) ET)</td>",
        date_optional=True,
        hints=("you have a direct deposit of $",),
    ),
    Template(
        name="Chase Transaction Alert - New1",
        account=r"(?:Chase [^(]+\(...(\d{4})\)|Account ending in[^<]*\(...(\d{4})\))",
        amount=r"(?:You made a \$(\d+(?:,\d{3})*(?:\.\d{2})?) transaction|You have a direct deposit of \$(\d+(?:,\d{3})*(?:\.\d{2})))",
        vendor=r"(?:transaction with ([^<\n\r]+)|Your \$\d+(?:,\d{3})*(?:\.\d{2})? transaction with ([^<\n\r]+))",
        date=r">([^<]+(?:AM|PM) ET)</td>",
        subject_pattern=r"Your \$[\d,.]+.*(?:transaction with|direct deposit)",
        subject_vendor=r"transaction with\s+([^<\n\r]+)",
        hints=("you made a $", "you have a direct deposit of $"),
    ),
    Template(
        name="Chase Test Format",
        account=r"(?:Account ending in[^(]*\(...|ending in)\s*(\d{4})",
        amount=r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?:made at|transaction with|at\s+|Merchant:\s*|purchase at\s+)([^<\n\r.]+?)(?=(?:\s+using|\s*$|\s*,|\s*\.|<br/>|\s+on))",
        date=r"(?:on|Date:|Transaction Date:)\s*([^<\n\r]+?)(?=(?:\s*$|\s*<|\s*executed|<br/>))",
        subject_pattern=r"(?:Chase Alert)",
        hints=("ending in",),
    ),
    Template(
        name="Chase Sapphire Preferred",
        account=r"(?:Chase [^(]+\(...(\d{4})\)|Account ending in[^<]*\(...(\d{4})\))",
        amount=r"(\$\d+(?:,\d{3})*(?:\.\d{2}))",
        vendor=r"(?s)(?<=Merchant</td>).*?<td[^>]*>\s*(.*?)\s*</td>",
        date=r"Date<\/td>[\s\S]*?<td[^>]*>\s*(?:<[^>]+>\s*)*([^<]+(?:AM|PM)\sET)",
        hints=("merchant</td>",),
    ),
    Template(
        name="Chase External Transfer",
        account=r"(?<=ending in )(\d*)(?=.)",
        amount=r"(?<=A \$)(.*)(?= external)",
        vendor=r"(?<=to )(.*)(?= on)",
        hints=(" external",),
    ),
    Template(
        name="Chase Debit Card",
        account=r"(?<=ending in )(\d*)(?=.)",
        amount=r"(?<=A \$)(.*)(?= debit)",
        vendor=r"(?<=to )(.*)(?= on)",
        hints=(" debit",),
    ),
    Template(
        name="Chase Checking Acct - Bill Pay",
        account=r"(?:Chase [^(]+\(...(\d{4})\)|Account ending in[^<]*\(...(\d{4})\))",
        amount=r"(\$\d+(?:,\d{3})*(?:\.\d{2}))",
        vendor=r"(?s)(?<=Recipient<\/td>).*?<td[^>]*>\s*(.*?)\s*<\/td>",
        date=r"Made on<\/td>[\s\S]*?<td[^>]*>\s*(?:<[^>]+>\s*)*([^<]+(?:AM|PM)\sET)",
        hints=("recipient</td>",),
    ),
    Template(
        name="Chase Credit Cards - HTML Template",
        account=r"<td[^>]*>(?:<.*?>)*([^<]+)(?:<\/.*?>)*<\/td>",
        amount=r"<td[^>]*>(?:<.*?>)*([^<]+)(?:<\/.*?>)*<\/td>",
        vendor=r"<td[^>]*>(?:<.*?>)*([^<]+)(?:<\/.*?>)*<\/td>",
        cells=True,
        hints=("<td",),
    ),
    Template(
        name="Huntington Checking/Savings Deposit",
        account=r"(?:CK|ending in|Last 4 #|Card ending in?\s*Card ending in|Account #|Account ending in|(?:account )?nicknamed CK)\s*(\d{4})",
        amount=r"(?:for )?\$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?:from\s+|at\s+|Merchant:\s*)([^<\n\r.]+?)(?=(?:\s+to|\s*$|\s*,|\s*\.|<br/>|\s+on))",
        date=r"(?:on|Date:|Transaction Date:|as of)\s*([^<\n\r]+?)(?=(?:\s*$|\s*<|\s*executed|<br/>))",
    ),
    Template(
        name="Huntington Checking/Savings Deposit2",
        account=r"(?<=CK)(\d{4})",
        amount=r"(?<=for \$)(([0-9,.]+)*)",
        vendor=r"(?<= at)(=?\s*)(.*)(?= from)",
        hints=("for $",),
    ),
    Template(
        name="Chase Payment Alert",
        account=r"Account ending in[^(]*\(\.\.\.([\d]{4})\)",
        amount=r"\$(\d+(?:,\d{3})*(?:\.\d{2})?)",
        vendor=r"(?:You sent \$[\d,.]+\s+to\s+)([^<\n\r]+)",
        date=r"Sent on\s+([^<]+)",
        hints=("you sent $",),
    ),
]

TEMPLATE_NAMES = [t.name for t in TEMPLATES]
