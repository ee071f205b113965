"""Errors that callers can tell apart."""


class SearchError(Exception):
    status = 500
    kind = "internal_error"


class IndexNotFoundError(SearchError):
    status, kind = 404, "index_not_found"


class AlreadyExistsError(SearchError):
    status, kind = 400, "already_exists"


class InvalidNameError(SearchError):
    status, kind = 400, "invalid_name"


class QueryParsingError(SearchError):
    status, kind = 400, "query_parsing"


class MapperParsingError(SearchError):
    status, kind = 400, "mapper_parsing"


class VersionConflictError(SearchError):
    status, kind = 409, "version_conflict"
