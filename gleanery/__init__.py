"""Web-page extraction, crawl-result selection and call-log analysis as Spark jobs."""
