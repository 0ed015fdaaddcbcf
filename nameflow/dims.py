"""Record types and response codes of the public IANA registries.

Fixed values, by number.  Numbers without an entry are printed as UNKNOWN_TYPE or in decimal.
"""

UNKNOWN_TYPE = "Unknown"

RECORD_TYPES = {
    1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR", 10: "NULL", 11: "WKS", 12: "PTR", 13: "HINFO",
    14: "MINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 19: "X25", 20: "ISDN", 21: "RT", 22: "NSAP", 23: "NSAP-PTR", 24: "SIG",
    25: "KEY", 26: "PX", 27: "GPOS", 28: "AAAA", 29: "LOC", 30: "NXT", 31: "EID", 32: "NIMLOC", 33: "SRV", 34: "ATMA", 35: "NAPTR",
    36: "KX", 37: "CERT", 38: "A6", 39: "DNAME", 40: "SINK", 41: "OPT", 42: "APL", 43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG",
    47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 55: "HIP", 56: "NINFO", 57: "RKEY",
    58: "TALINK", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 99: "SPF", 108: "EUI48",
    109: "EUI64", 249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR", 253: "MAILB", 254: "MAILA", 255: "ANY", 256: "URI", 257: "CAA",
}

#: Header and TSIG response codes.
RESPONSE_CODES = {
    0: "No Error", 1: "Form Error", 2: "Server Failure", 3: "Non-Existent Domain", 4: "Not Implemented", 5: "Query Refused", 6: "Name should not exist",
    7: "RR Set should not exist", 8: "RR Set does not exist", 9: "Not authorized", 10: "Name not in zone", 16: "TSIG Failure",
    17: "Key not recognized", 18: "Signature out of time window", 19: "Bad TKEY mode", 20: "Duplicate key name", 21: "Algorithm not supported", 22: "Bad truncation", 23: "Bad server cookie",
}
EDNS_BADVERS = "EDNS_BADVERS"

#: Names accepted for response codes, in lower case without spaces, hyphens and underscores.
CODE_ALIASES = {
    "noerror": 0, "formerr": 1, "formerror": 1, "servfail": 2, "serverfailure": 2, "nxdomain": 3, "nonexistentdomain": 3, "notimp": 4, "notimplemented": 4,
    "refused": 5, "queryrefused": 5, "yxdomain": 6, "nameshouldnotexist": 6, "yxrrset": 7, "rrsetshouldnotexist": 7, "nxrrset": 8, "rrsetdoesnotexist": 8,
    "notauth": 9, "notauthorized": 9, "notzone": 10, "namenotinzone": 10, "badvers": 16, "badoptionversions": 16, "ednsbadvers": 16, "badsig": 16, "tsigfailure": 16,
    "badkey": 17, "keynotrecognized": 17, "badtime": 18, "signatureoutoftimewindow": 18, "badmode": 19, "badtkeymode": 19, "badname": 20, "duplicatekeyname": 20,
    "badalg": 21, "algorithmnotsupported": 21, "badtrunc": 22, "badtruncation": 22, "badcookie": 23, "badservercookie": 23,
}
