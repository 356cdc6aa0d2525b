import pytest


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


RENDER = "render_id bigint, page_id bigint, html string, text string, block_count int, truncated boolean, blocks array<struct<type:string,text:string,src:string,alt:string,poster:string,title:string>>"
CARD = "card_id bigint, page_id bigint, provider string, title string, description string"
PAGE = "page_id bigint, url string, html string"
