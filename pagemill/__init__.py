"""pagemill: finding and extracting structured announcements in web pages with Spark."""
