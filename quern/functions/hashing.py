"""Hash functions over a value's text."""

from .strings import text

FUNCTIONS = {
    "MD5": lambda x: f"md5({text(x)})",
    "SHA1": lambda x: f"sha1({text(x)})",
    "SHA256": lambda x: f"sha2({text(x)}, 256)",
    "SHA384": lambda x: f"sha2({text(x)}, 384)",
    "SHA512": lambda x: f"sha2({text(x)}, 512)",
    "CRC32": lambda x: f"crc32({text(x)})",
}
