from gleanery.functions.html import (  # noqa: F401
    fix_lazy_images,
    frontmatter_metadata,
    is_valid_content,
    parse_frontmatter,
)
from gleanery.functions.text import (  # noqa: F401
    collapse_newlines,
    sanitize_text,
    strip_tags,
    trim_space,
    truncate_bytes,
    truncate_chars,
    trunc2,
)
from gleanery.functions.urls import (  # noqa: F401
    is_stealth,
    is_twitter,
    provider_request_url,
    route_class,
    tweet_api_url,
    url_domain,
    url_error,
    url_hash,
)
