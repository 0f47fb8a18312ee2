"""Plan rewrites that Catalyst doesn't make by itself."""
