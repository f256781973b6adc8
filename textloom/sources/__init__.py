"""Sources of documents: files, archives, package registries, sitemaps and web pages."""
